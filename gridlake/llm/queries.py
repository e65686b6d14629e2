"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from gridlake.llm import decontam, licenses, neighbours, ngram_join, packing, secrets, sharding, tokencount, toxicity, urlfilter
from gridlake.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_packing(spark, sf_dir):
    return packing.digest(table(spark, sf_dir, "documents"))


@query
def op10_sharding(spark, sf_dir):
    return sharding.digest(table(spark, sf_dir, "documents"))


@query
def op5_neighbours(spark, sf_dir):
    return neighbours.digest(table(spark, sf_dir, "embeddings"))


ORACLE["op5_neighbours"] = neighbours.SQL


@query
def op6_licenses(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark, sf_dir):
    return tokencount.digest(table(spark, sf_dir, "documents"))


@query
def op2_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


ORACLE["op2_ngram_join"] = ngram_join.SQL


@query
def op2_ngram_links(spark, sf_dir):
    """What op2_ngram_join gives, and each document's number of links."""
    return ngram_join.link_counts(table(spark, sf_dir, "documents"))


ORACLE["op2_ngram_links"] = ngram_join.LINKS_SQL


@query
def op4_decontamination(spark, sf_dir):
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op4_decontamination"] = decontam.SQL


@query
def op8_secrets(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


@query
def op3_url_filter(spark, sf_dir):
    return urlfilter.digest(table(spark, sf_dir, "pages"))
