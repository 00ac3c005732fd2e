"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. From it a Boolean trigram query is derived on the driver: literals give trigrams that all must
occur (and), alternatives give any of several (or); a rule without a mandatory trigram, such as a run of hexadecimal digits,
gives no query and is scanned fully. The index holds postings (trigram, doc_id) of the trigrams that any rule asks for, over the
lower-cased texts, as a table in the shared folder. A query's postings are intersected by gathering, for each document, the
trigrams it is posted under as bits, and testing the query on them. Candidates meet their texts again by doc_id, and the regular
expression itself decides; full-scan rules run on every text in the same pass.

Positions come from splitting at the expression: the lengths of the parts between matches and of the matches add up to offsets in
code points. Matches are leftmost and do not overlap, within a rule; rules may overlap each other.

Nulls and odd inputs: null text is empty. Rows with one doc_id share their candidates and are then each verified; null doc_ids
count as one. An empty table gives an empty result. Other columns pass through; of columns named as the results are, the
results' win.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as C  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    """pattern: valid for Python and Java alike. group, least: the shortest that group of a match may be, else it is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # whole runs, as [0-9a-f]+ of 24 or more
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
RESULTS = ("spans", "n_candidates")
MOST = 64  # strings that a part of an expression may stand for before it counts as unknown

# --- regular expression to query -------------------------------------------------------------------
# A query: True (anything), a trigram, ("and", queries) or ("or", queries). A part of an expression: (strings it is exactly one
# of, or None; query).


def _all(queries) -> object:
    q = {x for x in queries if x is not True}
    return True if not q else q.pop() if len(q) == 1 else ("and", frozenset(q))


def _any(queries) -> object:
    q = set(queries)
    if True in q:
        return True
    parts = {x: x[1] if x[0] == "and" else frozenset([x]) for x in q}
    q = {x for x in q if not any(parts[y] < parts[x] for y in q)}  # a or (a and b) is a
    return q.pop() if len(q) == 1 else ("or", frozenset(q))


def _of(strings: set[str]) -> object:
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings) if strings else True


def _sequence(items) -> tuple[set[str] | None, object]:
    known, exact, queries = {""}, True, []
    for item in items:
        own, q = _item(item)
        if own is not None and len(known) * len(own) <= MOST:
            known = {a + b for a in known for b in own}
            continue
        queries += [_of(known), q]
        known, exact = own if own is not None else {""}, False
    queries.append(_of(known))
    return (known if exact else None), _all(queries)


def _item(item) -> tuple[set[str] | None, object]:
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg).lower()}, True
    if op is C.IN:
        chars: set[str] = set()
        for o, a in arg:
            if o is C.LITERAL:
                chars.add(chr(a).lower())
            elif o is C.RANGE and a[1] - a[0] < MOST:
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(p[0] is not None for p in parts) and len(union := set().union(*[p[0] for p in parts])) <= MOST:
            return union, True
        return None, _any(_of(p[0]) if p[0] is not None else p[1] for p in parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        own, q = _sequence(inner)
        if own is not None and (low, high) == (0, 1) and len(own) < MOST:
            return own | {""}, True
        if own is not None and low == high and len(own) ** low <= MOST:
            return reduce(lambda a, b: {x + y for x in a for y in b}, [own] * low, {""}), True
        return None, q if low else True
    return None, True


def trigram_query(pattern: str) -> object:
    """The Boolean query of a pattern over lower-cased text; True if it has no mandatory trigram."""
    return _sequence(_parser.parse(pattern))[1]


def trigrams_of(query: object) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams_of, query[1]))


def holds(query: object, has) -> object:
    """The query as a condition; has gives that of one trigram."""
    if isinstance(query, str):
        return has(query)
    if query is True:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), [holds(q, has) for q in sorted(query[1], key=str)])


# --- index, candidates, verification ---------------------------------------------------------------

BITS = 62


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted(set().union(*[trigrams_of(trigram_query(r.pattern)) for r in rules]))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, doc_id): number of the trigram in vocabulary()."""
    found = [F.when(F.contains("__t", F.lit(g)), F.lit(i)) for i, g in enumerate(vocabulary(rules))]
    d = docs.select("doc_id", F.lower("text").alias("__t"))
    return d.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): numbers of the rules whose query the document's postings satisfy; documents with none are left out."""
    words = vocabulary(rules)
    sets = [F.bit_or(F.when((F.col("trigram") >= k) & (F.col("trigram") < k + BITS), F.expr(f"shiftleft(1L, trigram - {k})")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(0, max(len(words), 1), BITS)]
    place = {g: i for i, g in enumerate(words)}

    def has(g: str) -> Column:
        i = place[g]
        return F.col(f"b{i // BITS * BITS}").bitwiseAND(F.lit(1 << i % BITS).cast("long")) != 0

    asked = [(i, trigram_query(r.pattern)) for i, r in enumerate(rules)]
    true = [F.when(holds(q, has), F.lit(i)) for i, q in asked if q is not True]
    got = F.filter(F.array(*true), lambda x: x.isNotNull()) if true else F.array().cast("array<int>")
    return index.groupBy("doc_id").agg(*sets).select("doc_id", got.alias("rules")).filter(F.size("rules") > 0)


def _spans(rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end>> of a rule in __t."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    size = F.lit(0).cast("long")
    between, found = F.split("__t", rule.pattern, -1), F.regexp_extract_all("__t", F.lit(rule.pattern), F.lit(0))
    sized = found if not rule.least else F.regexp_extract_all("__t", F.lit(rule.pattern), F.lit(rule.group))
    part = F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("f"), sized.alias("s")), lambda x: F.struct(F.length(x["b"]).cast("long").alias("b"), F.length(x["f"]).cast("long").alias("f"), F.length(x["s"]).alias("s")))
    empty = F.struct(size.alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["f"]).alias("end")))
        return F.struct((start + x["f"]).alias("at"), F.concat(acc["out"], F.when(x["s"] >= rule.least, span).otherwise(none)).alias("out"))

    return F.when(F.col("__t").rlike(rule.pattern), F.aggregate(part, empty, step)["out"]).otherwise(none)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with spans: array<struct<start, kind, end>> in code points, by start, then kind (its number in rules), and
    n_candidates: rules whose query the index let through."""
    base = docs.select(*[c for c in docs.columns if c not in RESULTS])
    index = table(postings(base, rules), "postings")
    let = candidates(index, rules).withColumnRenamed("doc_id", "__doc").withColumnRenamed("rules", "__rules").hint("shuffle_hash")
    d = base.join(let, base["doc_id"].eqNullSafe(F.col("__doc")), "left")
    d = d.withColumn("__t", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    parts = []
    for i, r in enumerate(rules):
        spans = _spans(r, i)
        parts.append(spans if trigram_query(r.pattern) is True else F.when(F.array_contains("__rules", i), spans).otherwise(none))
    d = d.withColumn("spans", F.sort_array(F.concat(*parts))).withColumn("n_candidates", F.coalesce(F.size("__rules"), F.lit(0)).cast("long"))
    return d.select(*base.columns, *RESULTS)
