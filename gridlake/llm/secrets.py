"""Secret scans with a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: all clauses must hold, a clause holds if all trigrams of one
of its alternatives occur. The index posts, for each trigram that some query asks for, the documents whose
folded text (A-Z to a-z) holds it; postings are put together by document and each rule's query picks its candidates, which
alone are verified by the regex. A rule without a mandatory trigram scans every text. Candidate keys are broadcast only if
their number, counted first, is at most `broadcast_rows`; else Spark joins by shuffle.

Places of matches come from the text around them: the pieces between matches and the matches alternate, so their lengths
add up to code points (prefix sums by doubling, so that a text of many matches costs n log n). Redaction cuts the text into chunks once. Base kinds find leftmost non-overlapping matches first and then drop those that fail the length.

Defined results: null and empty texts have no span and the digest of nothing; repeated rows are scanned each; an empty
table gives no rows; extra columns are kept by scan() unless their names clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import lower_ascii, scratch, stored

BROADCAST_ROWS = 200_000
CHUNK = 4096  # characters of a text that redaction cuts at a time
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
MOST_STRINGS = 48  # of an exact set while a regex is read


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    least: int = 0  # characters of the group
    group: int = 0
    scan: str = ""  # a cheaper regex with the same kept matches, for rules that scan every text


RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, 0, r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

Clause = frozenset[frozenset[str]]


def _fold(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def _clause(strings: set[str]) -> list[Clause]:
    """One of the strings occurs: a clause over trigrams, or nothing where one is too short to have any."""
    if any(len(s) < 3 for s in strings):
        return []
    return [frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)]


def _read(nodes) -> tuple[set[str] | None, list[Clause]]:
    """(all strings the nodes can match, or None; clauses that any match fulfils)."""
    strings, clauses, whole = {""}, [], True
    for op, value in nodes:
        got, more = _read_node(op, value)
        clauses += more
        if got is not None and len(strings) * len(got) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in got}
            continue
        clauses += _clause(strings)
        strings, whole = got or {""}, False
    if whole:
        return strings, clauses
    return None, clauses + _clause(strings)


def _read_node(op, value) -> tuple[set[str] | None, list[Clause]]:
    if op is sre.LITERAL:
        return {_fold(chr(value))}, []
    if op is sre.AT:
        return {""}, []
    if op is sre.SUBPATTERN:
        return _read(value[-1])
    if op is sre.IN and len(value) <= 8 and all(o is sre.LITERAL for o, _ in value):
        return {_fold(chr(c)) for _, c in value}, []
    if op is sre.BRANCH:
        read = [_read(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in read) and len(joined := set().union(*(s for s, _ in read))) <= MOST_STRINGS:
            return joined, []
        each = [clauses + (_clause(strings) if strings is not None else []) for strings, clauses in read]
        return None, [frozenset().union(*(min(c, key=len) for c in each))] if all(each) else []
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        strings, clauses = _read(inner)
        if least == 0:
            return (strings | {""}, []) if most == 1 and strings is not None else (None, [])
        if least == most and strings is not None and len(strings) ** int(least) <= MOST_STRINGS and least <= 16:
            repeated = {""}
            for _ in range(least):
                repeated = {a + b for a in repeated for b in strings}
            return repeated, clauses
        return None, clauses + (_clause(strings) if strings is not None else [])
    return None, []


def trigram_query(regex: str) -> list[Clause]:
    """Clauses over folded trigrams that every match of the regex fulfils; empty if none is mandatory."""
    strings, clauses = _read(_parser.parse(regex))
    return list(dict.fromkeys(clauses + (_clause(strings) if strings is not None else [])))


def postings(docs: DataFrame, queries: dict[str, list[Clause]]) -> DataFrame:
    """(trigram, key): the inverted index, of the trigrams that the queries ask for."""
    asked = sorted({t for clauses in queries.values() for clause in clauses for option in clause for t in option})
    held = F.filter(F.array(*map(F.lit, asked)), lambda t: F.contains(F.col("_folded"), t))
    return docs.select("key", lower_ascii(F.col("text")).alias("_folded")).select(F.explode(held).alias("trigram"), "key")


def candidates(index: DataFrame, queries: dict[str, list[Clause]]) -> DataFrame:
    """(key, kinds): the documents whose postings fulfil a rule's query."""
    by_key = index.groupBy("key").agg(F.collect_set("trigram").alias("have"))

    def holds(clauses: list[Clause]) -> Column:
        every = F.lit(True)
        for clause in clauses:
            some = F.lit(False)
            for option in sorted(clause, key=sorted):
                some = some | (F.size(F.array_except(F.array(*map(F.lit, sorted(option))), "have")) == 0)
            every = every & some
        return every

    kinds = F.array_compact(F.array(*(F.when(holds(clauses), F.lit(kind)) for kind, clauses in queries.items())))
    return by_key.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, both) -> Column:
    """Running values of an array under an associative function, by doubling: after k steps each element covers 2^k."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int"))

    def step(state: Column, k: Column) -> Column:
        reach = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(state, lambda v, i: F.when(i >= reach, both(F.get(state, i - reach), v)).otherwise(v))

    return F.when(F.size(values) > 0, F.aggregate(steps, values, step)).otherwise(values)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of the rule's kept matches in code points, end exclusive."""
    regex = F.lit(rule.scan or rule.regex)
    between = F.transform(F.split(text, rule.scan or rule.regex, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    groups = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length)
    found = F.struct(between.alias("between"), matches.alias("matches"), groups.alias("groups"))

    def place(found: Column) -> Column:
        ends = _running(F.transform(found["matches"], lambda n, i: n + F.get(found["between"], i)), lambda x, y: x + y)
        rows = F.arrays_zip(ends.alias("end"), found["matches"].alias("size"), found["groups"].alias("group"))
        kept = F.filter(rows, lambda r: r["group"] >= rule.least)
        return F.transform(kept, lambda r: F.struct((r["end"] - r["size"]).alias("start"), F.lit(rank).alias("rank"), r["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    return _let(found, place)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with secrets array<struct<start, rank, end, kind>>, by start and then by rule; text null becomes none."""
    docs = docs.drop("secrets", "_key", "_kinds")
    keyed = docs.withColumn("_key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast(SPANS)
    if queries:
        with scratch(docs.sparkSession):
            index = postings(keyed.select(F.col("_key").alias("key"), "text"), queries)
            found = stored(candidates(index, queries), "secrets-candidates", keep=True)
        few = found.limit(broadcast_rows + 1).count() <= broadcast_rows
        found = found.select(F.col("key.id").alias("_id"), F.col("key.text").alias("_hash"), F.col("kinds").alias("_kinds"))
        same = F.col("_id").eqNullSafe(F.col("_key.id")) & (F.col("_hash") == F.col("_key.text"))
        keyed = keyed.join(F.broadcast(found) if few else found, same, "left").drop("_id", "_hash")
    else:
        keyed = keyed.withColumn("_kinds", F.lit(None).cast("array<string>"))
    each = []
    for rank, rule in enumerate(rules):
        chosen = F.array_contains("_kinds", rule.kind) if rule.kind in queries else text.rlike(rule.scan or rule.regex)
        each.append(F.when(chosen, _spans(text, rule, rank)).otherwise(none))
    return keyed.withColumn("secrets", F.array_sort(F.concat(*each))).drop("_key", "_kinds")


def _cut(chunks: Column, begin: Column, end: Column) -> Column:
    """The characters [begin, end) of a text in chunks."""
    a, b = F.floor(begin / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    part = lambda k, at, n: F.coalesce(F.substring(F.get(chunks, k), at + 1, n), F.lit(""))
    across = F.concat(part(a, begin % CHUNK, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), part(b, F.lit(0), end % CHUNK))
    return F.when(a == b, part(a, begin % CHUNK, end - begin)).otherwise(across)


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each run of overlapping spans, which are sorted by start."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    reach = _running(F.transform(spans, lambda s: s["end"]), F.greatest)

    def body(known: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(known["reach"], i - 1)).otherwise(0)
        pieces = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(_cut(known["chunks"], before(i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), _cut(known["chunks"], F.element_at(known["reach"], -1), F.length(text)))

    return _let(F.struct(chunks.alias("chunks"), reach.alias("reach")), body)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of the text replaced by the mark; overlapping secrets become one mark."""
    found = scan(docs)
    return found.withColumn("text", F.when(F.size("secrets") > 0, _redacted(F.col("text"), F.col("secrets"), mark)).otherwise(F.col("text"))).drop("secrets")


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text")).select("doc_id", "secrets")
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *map(count, BASE),
        F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", named), ",").alias("spans"),
    )
