"""Secret scans over a trigram inverted index, in DataFrame operations only (operator 1)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import P


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern`, leftmost and non-overlapping, whose `group` has `least`
    characters or more.  `fold`: ASCII letters of the pattern match in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.fold else "") + self.pattern


#: The three base kinds of the contract, in its order.  Runs that the contract drops for
#: their length are left to the pattern where that changes no other match.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, fold=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Further public token formats.
MORE = [
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
]
RULES = BASE + MORE

#: Strings that a part of a pattern may stand for before it counts as open.
MOST = 64


def _strings(nodes) -> set[str] | None:
    """All strings that the nodes match in full, or None if they are too many."""
    out = {""}
    for op, arg in nodes:
        if op is C.LITERAL:
            own = {chr(arg)}
        elif op is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in arg):
            own = {chr(c) for k, v in arg for c in ([v] if k is C.LITERAL else range(v[0], v[1] + 1))}
        elif op is C.SUBPATTERN:
            own = _strings(arg[3])
        elif op is C.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            own = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 4 and (one := _strings(arg[2])) is not None and len(one) ** arg[1] <= MOST:
            own = {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
        else:
            own = None
        if own is None or len(out) * len(own) > MOST:
            return None
        out = {a + b for a in out for b in own}
    return out


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[k : k + 3] for k in range(len(s) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The Boolean query that a pattern implies for any text with a match: clauses joined by OR, each of
    trigrams (in lower case) joined by AND; None if it has no mandatory trigram, so that all texts are read.

    The parsed pattern is walked in sequence; parts that stand for few strings are multiplied out, an open
    part ends the run, and a run each of whose strings is three characters or longer is one OR of ANDs."""
    need: list[set[frozenset[str]]] = []
    run: set[str] = {""}

    def flush() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            need.append({_trigrams(s.lower()) for s in run})
        run = {""}

    for node in _parser.parse(pattern):
        own = _strings([node])
        if own is None or len(run) * len(own) > MOST:
            flush()
        if own is not None:
            run = {a + b for a in run for b in own}
    flush()
    clauses = {frozenset()}
    for options in need:
        if len(clauses) * len(options) <= MOST:
            clauses = {a | b for a in clauses for b in options}
    clauses = {c for c in clauses if not any(o < c for o in clauses)}
    return None if frozenset() in clauses else sorted(clauses, key=sorted)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def postings(df: DataFrame, text: str, terms: list[str], key: str) -> DataFrame:
    """The inverted index for the terms that the rules can ask for: (term, key), once for each text."""
    found = bound(F.lower(F.col(text)), lambda low: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t)))
    return df.select(F.col(key), F.explode(found).alias("term")).distinct()


def candidates(df: DataFrame, text: str, rules: list[Rule], key: str) -> DataFrame:
    """(key, rules): the indices of the rules whose trigram query holds for the text.  Each clause's
    postings are intersected by counting its terms within a text."""
    asked = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    rows = [(t, k, j, len(c)) for k, q in asked.items() for j, c in enumerate(q) for t in sorted(c)]
    clauses = df.sparkSession.createDataFrame(rows, "term string, rule int, clause int, need int")
    index = postings(df, text, sorted({r[0] for r in rows}), key)
    met = index.join(F.broadcast(clauses), "term").groupBy(key, "rule", "clause").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    return met.where(F.col("n") == F.col("need")).groupBy(key).agg(F.collect_set("rule").alias("rules"))


def in_blocks(items: Column, zero: Column, carry, use, block: int = 256) -> Column:
    """use(block, state) for each run of `block` items, as an array: state is zero and then, before each further
    run, carry(state, run before).  What a fold over all items would append to one growing result is so built a
    run at a time, in about linear time."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / block).cast("int")), lambda k: F.slice(items, k * block + 1, block))
    step = lambda acc, run: F.concat(acc, F.array(carry(F.element_at(acc, -1), run)))
    return bound(cut, lambda runs: bound(F.aggregate(runs, F.array(zero), step), lambda states: F.transform(runs, lambda run, k: use(run, F.get(states, k)))))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as array<struct<start,ord,stop,kind>>, in code points, stop exclusive."""
    pattern = F.lit(rule.java)
    parts = F.arrays_zip(F.split(text, rule.java, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))
    sized = F.transform(parts, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.coalesce(F.char_length(x["hit"]), F.lit(0)).alias("hit"), F.char_length(x["part"]).alias("part")))
    span = lambda a, b: F.struct(a.alias("start"), F.lit(order).alias("ord"), b.alias("stop"), F.lit(rule.kind).alias("kind"))
    none = F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["hit"]
        return F.struct(stop.alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["out"], F.array(span(start, stop)))).otherwise(acc["out"]).alias("out"))

    past = lambda at, run: F.aggregate(run, at, lambda s, x: s + x["gap"] + x["hit"])
    within = lambda run, at: F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    found = bound(sized, lambda items: F.flatten(in_blocks(items, F.lit(0), past, within)))
    return F.when(text.rlike(rule.java), found).otherwise(none)


def scan(df: DataFrame, text: str = "text", out: str = "spans", rules: list[Rule] = RULES) -> DataFrame:
    """df and the column `out`: every secret of the whole text, by start, then rule, as
    array<struct<start,ord,stop,kind>>.

    A null or empty text has none; repeated rows are each answered; all columns of df stay (a column named
    as `out` is replaced).  The trigram index is keyed by a hash of the text: copies share their postings,
    and two texts that share a hash can only add a text to verify.  Rules without a mandatory trigram read
    every text.  The join back to the texts is an equi-join that AQE can split where copies abound."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = df.withColumn(f"{P}k", F.xxhash64(body))
    found = candidates(d.select(body.alias(f"{P}t"), f"{P}k"), f"{P}t", rules, f"{P}k").select(F.col(f"{P}k").alias(f"{P}k2"), F.col("rules").alias(f"{P}rules"))
    d = d.join(found, F.col(f"{P}k") == F.col(f"{P}k2"), "left")
    none = F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")
    each = []
    for k, r in enumerate(rules):
        own = spans_of(body, r, k)
        each.append(own if trigram_query(r.pattern) is None else F.when(F.coalesce(F.array_contains(f"{P}rules", k), F.lit(False)), own).otherwise(none))
    return d.withColumn(out, F.array_sort(F.concat(*each))).drop(f"{P}k", f"{P}k2", f"{P}rules")


def joined(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of spans that touch or overlap replaced by the mark.

    A block of spans works on its own stretch of the text, from the end of what the blocks before have
    covered to its own, so no span is looked up from the text's start."""
    own = lambda s: s["stop"]

    def past(at: Column, run: Column) -> Column:
        return F.greatest(at, F.array_max(F.transform(run, own)))

    def within(run: Column, at: Column) -> Column:
        stretch = F.substring(text, at + 1, past(at, run) - at)

        def cut(part: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                new = s["start"] >= acc["at"]
                gap = F.substring(part, acc["at"] - at + 1, s["start"] - acc["at"])
                # a span that touches the one before it joins that one's mark
                apart = (s["start"] > acc["at"]) | (acc["at"] == 0)
                return F.struct(
                    F.greatest(acc["at"], s["stop"]).alias("at"),
                    F.when(new & apart, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
                )

            return F.aggregate(run, F.struct(at.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

        return bound(stretch, cut)

    end = F.substring(text, F.array_max(F.transform(spans, own)) + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(in_blocks(spans, F.lit(0), past, within), ""), end)).otherwise(text)
