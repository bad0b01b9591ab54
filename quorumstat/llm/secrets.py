"""Secret scans through a trigram inverted index, in native DataFrame expressions.

Each rule's regular expression is reduced to a Boolean trigram query: an OR over its
literal alternatives of the AND of their trigrams.  The index holds a posting (trigram,
document) for every trigram that some query names; a document is a candidate of a rule
if its postings satisfy the query.  Rules without mandatory trigrams scan every text.
Candidates are verified with the whole expression, and matches are located by the
running lengths of the text between them.

Edge cases: a null or empty text has no spans; a row without id, or whose id repeats
with other texts, is verified like any other; an empty table gives no rows; other input
columns stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, let

GAP = "\0"
#: Matches of one rule in one text that the running sums cover: 2 to this power, beyond the longest array there can
#: be; steps beyond an array's size leave it as it is.
SUM_STEPS = 31
#: Characters of the blocks in which a text is cut.
BLOCK = 1000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    #: A match stays if this group has at least so many characters.
    group: int = 0
    least: int = 0

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


# The base rules.  The hexadecimal and access-key lengths are inside the
# expressions, which finds the same spans as filtering the maximal runs.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Published shapes of credentials.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


def _literals(tree, limit: int = 64) -> list[str]:
    """What a parsed expression must contain: alternatives, each literal text with GAP where anything may stand."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "SUBPATTERN":
            more = _literals(arg[3], limit)
        elif name == "BRANCH":
            more = [x for t in arg[1] for x in _literals(t, limit)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            more = [chr(c) for _, c in arg]
        elif name == "MAX_REPEAT" and arg[1] == 1:
            more = ["", *_literals(arg[2], limit)]
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            more = [x * arg[0] + GAP * (arg[1] != arg[0]) for x in _literals(arg[2], limit)] if arg[0] <= 8 else [GAP]
        else:
            more = [GAP]
        out = [a + b for a, b in product(out, more)] if len(out) * len(more) <= limit else [a + GAP for a in out]
    return out


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-cased trigrams that every match contains; None if a match may contain none."""
    from re import _parser

    alternatives = set()
    for text in _literals(_parser.parse(rule.pattern)):
        runs = text.lower().split(GAP)
        alternatives.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    return None if frozenset() in alternatives else sorted(alternatives, key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, id) of the given lower-cased trigrams."""
    lowered = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low"))
    flags = [F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in trigrams]
    return lowered.select(id_col, F.explode(F.array_compact(F.array(*flags))).alias("trigram"))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix sums, or prefixes of another associative `join`, of an array, by doubling."""

    def shifted_by(by: int):
        return lambda p: F.when(F.size(p) <= by, p).otherwise(F.transform(p, lambda x, i: F.when(i >= by, join(x, F.get(p, i - by))).otherwise(x)))

    for step in range(SUM_STEPS):
        values = let(values, shifted_by(1 << step))
    return values


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct(start, kind_order, end, kind)> of the rule's spans, in code points.  The text is searched and split
    once, not for every match."""
    enough = lambda m: F.char_length(F.regexp_extract(m, rule.java, rule.group)) >= rule.least if rule.least else F.lit(True)

    def located(both: Column) -> Column:
        steps = F.transform(both["matches"], lambda m, i: F.char_length(F.get(both["between"], i)) + F.char_length(m))
        return F.zip_with(
            both["matches"], _running(steps, lambda x, y: x + y),
            lambda m, e: F.struct((e - F.char_length(m)).cast("long").alias("start"), F.lit(order).alias("kind_order"), e.cast("long").alias("end"), F.lit(rule.kind).alias("kind"), enough(m).alias("ok")),
        )

    both = F.struct(F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)).alias("matches"), F.split(text, rule.java, -1).alias("between"))
    return F.filter(let(both, located), lambda s: s["ok"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, id_col: str = "doc_id", text_col: str = "text", to: str = "spans") -> DataFrame:
    """`docs` with array column `to` (in place of one of that name): struct(start, kind_order, end, kind, ok), ordered by
    start and then rule."""
    id_name, has_name, rules_name = free_names(docs, "_id", "_has", "_rules")
    queries = {r.kind: trigram_query(r) for r in rules}
    trigrams = sorted({t for q in queries.values() for alt in q or () for t in alt})
    index = trigram_index(docs, trigrams, id_col, text_col)
    postings = index.groupBy(F.col(id_col).alias(id_name)).agg(F.collect_set("trigram").alias(has_name))
    has = F.col(has_name)
    wanted = [
        F.when(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains(has, t) for t in sorted(alt)]) for alt in q]), F.lit(kind))
        for kind, q in queries.items()
        if q is not None
    ]
    candidates = postings.select(id_name, F.array_compact(F.array(*wanted)).alias(rules_name)).where(F.size(rules_name) > 0)
    joined = docs.join(candidates, F.col(id_col) == F.col(id_name), "left").drop(id_name)
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,kind:string,ok:boolean>>")
    found = []
    for order, rule in enumerate(rules):
        candidate = F.rlike(text, F.lit(rule.java))
        if queries[rule.kind] is not None:
            candidate = (F.col(id_col).isNull() | F.coalesce(F.array_contains(rules_name, rule.kind), F.lit(False))) & candidate
        found.append(F.when(candidate, spans_of(text, rule, order)).otherwise(none))
    return joined.withColumn(to, F.array_sort(F.concat(*found))).drop(rules_name)


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _between(blocks: Column, lo: Column, hi: Column) -> Column:
    """Characters lo to hi of a text held as blocks of BLOCK characters: a long text is not walked from its start each time."""
    place = lambda x: F.floor(x / BLOCK).cast("int")
    inside = lambda x: (x % BLOCK).cast("int")
    block = lambda x: F.coalesce(F.get(blocks, place(x)), F.lit(""))
    one = F.substring(block(lo), inside(lo) + 1, (hi - lo).cast("int"))
    more = F.concat(F.substring(block(lo), inside(lo) + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, place(lo) + 2, place(hi) - place(lo) - 1), ""), F.substring(block(hi), F.lit(1), inside(hi)))
    return F.when(place(lo) == place(hi), one).otherwise(more)


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with its spans, ordered by start, replaced; a span that begins before the furthest end so far joins it."""

    def pieces(blocks: Column, upto: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(upto, i - 1))
        begins = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= before(i))
        kept = F.transform(begins, lambda i: _between(blocks, before(i), F.get(spans, i)["start"]))
        rest = _between(blocks, F.element_at(upto, -1), F.char_length(text).cast("long"))
        return F.array_join(F.concat(kept, F.array(rest)), mark)

    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(blocks, lambda b: let(ends, lambda upto: pieces(b, upto)))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span of the text replaced by `mark`; overlapping spans become one mark, other columns stay."""
    (spans,) = free_names(docs, "_spans")
    found = scan(docs, rules, id_col, text_col, spans)
    cleaned = let(F.col(spans), lambda s: F.when(F.size(s) > 0, _without(F.col(text_col), s, mark)).otherwise(F.col(text_col)))
    return found.withColumn(text_col, cleaned).drop(spans)


def pattern_matches(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Spans of one rule in one text by the standard library: the check of the native form in tests."""
    found = re.finditer(rule.pattern, text, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))
    return [m.span() for m in found if not rule.least or len(m[rule.group]) >= rule.least]
