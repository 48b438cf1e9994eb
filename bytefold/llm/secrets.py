"""Secret scans by a trigram inverted index, in DataFrame functions only.

Method: every rule's regular expression is compiled on the driver into a Boolean query over lower-case trigrams that
any match must hold. One pass over a text finds those of all the queries' trigrams that it has; they are its terms in an
index whose other side are the rules. Each query intersects and unites the postings of its trigrams, and only texts
that are left are searched with the rule's expression. A rule without mandatory trigrams scans every text. The index
only ever removes texts that cannot match, so results equal a full scan. Rules are few and fixed, so the index of a
text stands beside it, and no text is moved.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MOST_STRINGS = 64  # that a part of an expression may stand for, before it ends a run of characters


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and do not overlap; those whose `group` has fewer than `least` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    scan: str | None = None  # an expression that finds the same kept matches, cheaper where short ones abound


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, "[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

Query = list[list[list[str]]]  # all of: any of: all of these trigrams


@dataclass(frozen=True)
class Node:
    """A part of an expression: `set` (characters, None for too many to tell), `group` (branches, each a sequence of parts)
    or `repeat` (one part, from `low` to `high` times, None for no end)."""

    kind: str
    of: object
    low: int = 1
    high: int | None = 1


class _Parser:
    """Reads the expressions that rules may use: literals, classes, groups, branches, counts, the case flag ahead."""

    SPECIAL = {"d": "0123456789", "n": "\n", "t": "\t", "r": "\r"}

    def __init__(self, pattern: str):
        self.text, self.at = pattern.removeprefix("(?i)"), 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"the expression {self.text} ends too early")
        self.at += 1
        return c

    def branches(self) -> list[list[Node]]:
        out: list[list[Node]] = [[]]
        while self.peek() and self.peek() != ")":
            if self.peek() == "|":
                self.at += 1
                out.append([])
            else:
                out[-1].append(self.counted(self.part()))
        return out

    def escaped(self) -> str | None:
        c = self.take()
        if c == "x":
            return chr(int(self.take() + self.take(), 16))
        if c in "wWsSDbB":
            return None
        return self.SPECIAL.get(c, c)

    def part(self) -> Node:
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                if self.text[self.at : self.at + 2] != "?:":
                    raise ValueError(f"no group of this kind in rules: {self.text}")
                self.at += 2
            inside = self.branches()
            self.take()
            return Node("group", inside)
        if c == "[":
            return Node("set", self.charset())
        if c == "\\":
            found = self.escaped()
            return Node("set", found and frozenset(found))
        if c in ".^$":
            return Node("set", None) if c == "." else Node("group", [[]])
        return Node("set", frozenset(c))

    def charset(self) -> frozenset | None:
        negated, found, first = self.peek() == "^", set(), True
        self.at += negated
        known = not negated
        while first or self.peek() != "]":
            first, c = False, self.take()
            low = self.escaped() if c == "\\" else c
            if low is None or len(low) != 1:
                known, found = known and low is not None, found | set(low or ())
                continue
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                found |= {chr(k) for k in range(ord(low), ord(self.take()) + 1)}
            else:
                found.add(low)
        self.at += 1
        return frozenset(found) if known else None

    def counted(self, one: Node) -> Node:
        c = self.peek()
        if c and c in "*+?":
            self.at += 1
            out = Node("repeat", one, int(c == "+"), 1 if c == "?" else None)
        elif m := re.compile(r"\{(\d+)(,(\d*))?\}").match(self.text, self.at):
            self.at = m.end()
            out = Node("repeat", one, int(m[1]), int(m[1]) if m[2] is None else int(m[3]) if m[3] else None)
        else:
            return one
        if self.peek() in ("?", "+") and self.peek():  # lazy and possessive ones match in the same texts
            self.at += 1
        return out


def trigram_query(pattern: str) -> Query:
    """The trigrams that a match needs: a conjunction of clauses, each a choice of trigram sets. No clause: no need."""
    clauses: list[list[list[str]]] = []

    def close(strings: set[str]) -> set[str]:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        least = sorted(sorted(s) for s in sets if not any(other < s for other in sets))  # a set that holds another needs no asking
        if all(least) and least and least not in clauses:
            clauses.append(least)
        return {""}

    def strings_of(node: Node) -> set[str] | None:
        """The lower-case strings that a part can match, if they are few and ASCII."""
        if node.kind == "set":
            found = {c.lower() for c in node.of} if node.of and all(ord(c) < 128 for c in node.of) else None
            return found if found and len(found) <= 8 else None
        if node.kind == "group":
            parts = [sequence(x) for x in node.of]
            return None if None in parts else set().union(*parts)
        if node.high is None or node.high > 2:
            return None
        once = strings_of(node.of)
        if once is None:
            return None
        found, grown = {""} if node.low == 0 else set(), {""}
        for n in range(1, node.high + 1):
            grown = {a + b for a in grown for b in once}
            found |= grown if n >= node.low else set()
        return found if len(found) <= MOST_STRINGS else None

    def sequence(items: list[Node]) -> set[str] | None:
        out = {""}
        for node in items:
            more = strings_of(node)
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items: list[Node], have: set[str]) -> set[str]:
        for node in items:
            more = strings_of(node)
            if more is not None and len(have) * len(more) <= MOST_STRINGS:
                have = {a + b for a in have for b in more}
                continue
            have = close(have)
            if more is not None:
                have = more
            elif node.kind == "group" and len(node.of) == 1:
                have = close(walk(node.of[0], have))
            elif node.kind == "repeat" and node.low >= 1:
                have = close(walk([node.of], have))
        return have

    whole = _Parser(pattern).branches()
    close(walk(whole[0] if len(whole) == 1 else [Node("group", whole)], {""}))
    return clauses


def trigram_expression(grams: list[str]) -> str:
    """An expression that finds every place of every trigram, as group 1: by first character, then second, then third."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(grams):
        tree.setdefault(a, {}).setdefault(b, []).append(c)
    one = lambda cs: re.escape(cs[0]) if len(cs) == 1 else f"[{''.join(map(re.escape, cs))}]"
    branches = [re.escape(a) + "(?:" + "|".join(re.escape(b) + one(cs) for b, cs in below.items()) + ")" for a, below in tree.items()]
    return f"(?={one(list(tree))})(?=({'|'.join(branches)}))"


def _holds(terms: Column, query: Query) -> Column:
    """Whether the trigrams of a text meet a query: of every clause, all of one of its sets."""

    def all_of(grams: list[str]) -> Column:
        return F.size(F.array_intersect(terms, F.array(*[F.lit(g) for g in grams]))) == len(grams)

    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [all_of(one) for one in clause]) for clause in query])


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """`docs` (any with a `text`) with `kinds`, the rules that need trigrams and whose trigrams the text holds."""
    plans = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    if not plans:
        return docs.withColumn("kinds", F.array().cast("array<string>"))
    grams = sorted({g for q in plans.values() for clause in q for one in clause for g in one})
    (terms,) = fresh(docs, "__terms")
    indexed = docs.withColumn(terms, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(trigram_expression(grams)), F.lit(1))))
    met = F.array_compact(F.array(*[F.when(_holds(F.col(terms), q), F.lit(k)) for k, q in plans.items()]))
    return indexed.withColumn("kinds", met).drop(terms)


STRETCH = 256
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _running(sizes: Column) -> Column:
    """The sums of an array of numbers up to each place, in stretches, so that no long array is copied for each number."""

    def sums(xs: Column, begin: Column) -> Column:
        state = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(xs, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["sums"], s["at"] + x).alias("sums")), lambda s: s["sums"])

    many = F.ceil(F.size(sizes) / STRETCH).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda k: F.slice(sizes, k * STRETCH + 1, STRETCH))
    ends = sums(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.transform(parts, lambda p, k: sums(p, F.when(k == 0, 0).otherwise(F.get(ends, k - 1)))))


def _spans(rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of the kept matches of a rule in `text`, in code points."""
    pattern = rule.scan or rule.pattern
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group)) if rule.group else hits
    gaps = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(hits))
    ends = _running(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)))
    each = F.zip_with(F.arrays_zip(ends.alias("end"), hits.alias("hit")), kept, lambda e, k: F.struct((e["end"] - F.length(e["hit"])).alias("start"), F.lit(rank).alias("rank"), e["end"].alias("end"), F.lit(rule.kind).alias("kind"), (F.length(k) >= rule.least).alias("good")))
    found = F.transform(F.filter(each, lambda e: e["good"]), lambda e: F.struct(e["start"], e["rank"], e["end"], e["kind"]).cast(SPAN))
    return F.when(F.col("text").rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """All columns of `docs` (any with a `text`), and `secrets`: array<struct<start, rank, end, kind>> ordered by start, then
    rule; it takes the place of a column of that name.

    A null or empty text has none. Rows may repeat; each row stays, whatever its columns hold. An empty table gives none.
    """
    docs = docs.drop("secrets")
    whole, kinds = fresh(docs, "__whole", "__kinds")
    names = [F.col(f"`{c}`") for c in docs.columns]
    texts = docs.select(*names, F.col("text").alias(whole)).withColumn("text", F.coalesce("text", F.lit("")))
    had = [c for c in texts.columns if c.lower() == "kinds"]
    texts = texts.withColumnsRenamed({c: f"{kinds}_{c}" for c in had})
    found = candidates(texts, rules).withColumnRenamed("kinds", kinds).withColumnsRenamed({f"{kinds}_{c}": c for c in had})
    parts = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule, rank)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains(kinds, rule.kind), spans).otherwise(F.array().cast(f"array<{SPAN}>"))
        parts.append(spans)
    out = found.withColumn("secrets", F.sort_array(F.concat(*parts)))
    return out.withColumn("text", F.col(whole)).select(*names, "secrets")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The scanned rows with every stretch of `text` that a span covers replaced by `mark`; overlapping spans make one stretch."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, p: Column) -> Column:
        fresh = p["start"] >= s["at"]
        gap = F.when(fresh, F.concat(F.substring(F.col("text"), s["at"] + 1, p["start"] - s["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), F.concat(s["out"], gap).alias("out"))

    done = F.aggregate("secrets", state, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return scanned.withColumn("text", F.when(F.size("secrets") > 0, done).otherwise(F.col("text")))


def _sql_spans(rule: Rule, rank: int) -> str:
    pattern = (rule.scan or rule.pattern).replace("'", "''")
    starts = "list_transform(range(1, len(h) + 1), lambda i: coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))"
    return (
        f"SELECT r, {rank} AS rk, '{rule.kind}' AS kind, unnest({starts})::BIGINT AS s, unnest(list_transform(h, lambda x: length(x)))::BIGINT AS n, unnest(list_transform(k, lambda x: length(x)))::BIGINT AS kept "
        f"FROM (SELECT r, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS h, regexp_extract_all(t, '{pattern}', {rule.group}) AS k FROM d WHERE regexp_matches(t, '{pattern}'))"
    )


def oracle(rules=RULES) -> str:
    spans = " UNION ALL ".join(f"SELECT * FROM ({_sql_spans(r, i)}) WHERE kept >= {r.least}" for i, r in enumerate(rules))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({spans}),
a AS (SELECT r, count(*) FILTER (rk = 0) AS n_assign, count(*) FILTER (rk = 1) AS n_access, count(*) FILTER (rk = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rk) FILTER (rk < {len(BASE)}), '') AS base,
  coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rk), '') AS spans FROM m GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""
