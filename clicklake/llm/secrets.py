"""Secret scans: regular expressions behind an inverted index of trigrams.

From each expression a Boolean query over trigrams is derived, in conjunctive groups: of every
match, the trigrams of one group are in the text. Postings of the trigrams that some query
names are made of all texts, the queries intersect them, and only candidates are matched
against the expression. Rules without such trigrams are matched against every text.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Sequence
from re import _constants as kinds_of  # the names of the parts of a parsed expression
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, literal_rows, stored


class Rule(NamedTuple):
    """One kind of secret.

    ``pattern`` is matched leftmost and without overlap; matches whose ``group`` has under
    ``least`` characters are dropped.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules. A run of 24 or more is the same as a run that is dropped below 24.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Further kinds, by their published prefixes.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE

# What is hidden of a PEM key: all up to its end line, or, where that is missing (cut off, or
# another dashed line comes first), the header fields and lines of base64 that follow. Line
# breaks may be escaped. Loops are possessive, so that a key of any length is matched.
_BREAK = r"(?:\s|\\++[rn])++"
_FULL_LINES = rf"(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+=*+)*+"
_LAST_LINE = rf"(?:[\x20\t]*+(?:[\r\n]|\\++[rn]){_BREAK[:-2]}*+[A-Za-z0-9+/]++=*+(?=[\x20\t]*+(?:[\r\n\\\"']|\z)))?+"
PEM_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_BREAK}[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+{_FULL_LINES}{_LAST_LINE})"
)
# The rules for hiding: a scan reports the header line of a PEM key, hiding takes the key.
HIDING = tuple(rule._replace(pattern=PEM_KEY) if rule.kind == "pem" else rule for rule in RULES)


# Candidates that go to every task, as bytes of their keys and kinds; of more, texts move to them.
MOST_TOLD = 16 * 2**20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Strings that a part of an expression stands for are followed up to so many.
MOST_STRINGS, MOST_CHARACTERS = 64, 8


def _lower(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def _best(sets: list[frozenset]) -> frozenset:
    """Of sets of strings, one of which each match holds, the one that says most; none if no set says anything."""
    useful = [s for s in sets if s and min(map(len, s)) >= 3]
    return max(useful, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def _characters(items: list) -> frozenset | None:
    """The characters of a class, if they are few."""
    found: set[str] = set()
    for kind, value in items:
        if kind == kinds_of.LITERAL:
            found.add(_lower(chr(value)))
        elif kind == kinds_of.RANGE and value[1] - value[0] < 4 * MOST_CHARACTERS:
            found |= {_lower(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= MOST_CHARACTERS else None


def _part(kind, value) -> tuple[frozenset | None, frozenset]:
    """Of one part of an expression: the strings it matches, if few; and strings of which a match holds one."""
    none = frozenset()
    if kind == kinds_of.LITERAL:
        return frozenset([_lower(chr(value))]), none
    if kind == kinds_of.IN:
        return _characters(value), none
    if kind in (kinds_of.AT, kinds_of.ASSERT, kinds_of.ASSERT_NOT):
        return frozenset([""]), none
    if kind == kinds_of.SUBPATTERN:
        return _parts(value[-1])
    if kind == kinds_of.ATOMIC_GROUP:
        return _parts(value)
    if kind == kinds_of.BRANCH:
        ways = [_parts(way) for way in value[1]]
        exact = [strings for strings, _ in ways]
        whole = frozenset().union(*exact) if None not in exact else None
        held = [_best([strings or none, inside]) for strings, inside in ways]
        inside = frozenset().union(*held) if all(held) else none
        return (whole if whole is not None and len(whole) <= MOST_STRINGS else None), inside
    if kind in (kinds_of.MAX_REPEAT, kinds_of.MIN_REPEAT, kinds_of.POSSESSIVE_REPEAT):
        least, most, repeated = value
        strings, inside = _parts(repeated)
        if most == 1 and strings is not None:
            return (strings | {""} if least == 0 else strings), none
        if least == 0:
            return None, none
        if strings is not None and least == most and len(strings) ** least <= MOST_STRINGS:
            return frozenset("".join(row) for row in itertools.product(strings, repeat=least)), none
        return None, _best([strings or none, inside])
    return None, none


def _parts(parts) -> tuple[frozenset | None, frozenset]:
    """The same of parts in a row: neighbours of few strings are put together."""
    held, row, whole = [], frozenset([""]), True
    for kind, value in parts:
        strings, inside = _part(kind, value)
        if strings is not None and len(row) * len(strings) <= MOST_STRINGS:
            row = frozenset(a + b for a in row for b in strings)
            continue
        held += [row, inside]
        row, whole = (strings if strings is not None else frozenset([""])), False
    return (row, frozenset()) if whole else (None, _best([*held, row]))


@functools.cache
def literals(pattern: str) -> frozenset:
    """Strings of which every match of an expression holds at least one, ASCII letters in lower case.

    None is told if there are none of three characters, or if the expression has parts that
    are not known here; its rule then scans every text.
    """
    try:
        parsed = parser.parse(pattern.replace(r"\z", r"\Z"))
    except re.error:
        return frozenset()
    strings, inside = _parts(parsed)
    return _best([strings or frozenset(), inside])


def trigrams(literal: str) -> list[str]:
    """The trigrams of a literal; one of under three characters has none."""
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def trigram_query(rule: Rule) -> list[list[str]]:
    """The Boolean query of a rule: one of the groups must be there whole.

    An empty query means that no trigram is mandatory. A group that holds all of another one
    adds nothing and is left out.
    """
    groups = sorted({frozenset(trigrams(literal)) for literal in literals(rule.pattern)}, key=lambda g: (len(g), sorted(g)))
    least: list[frozenset] = []
    for group in groups:
        if not any(other <= group for other in least):
            least.append(group)
    return [sorted(group) for group in least]


def postings(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: ``trigram`` and ``key``, a row per trigram of a query and text with it.

    Trigrams are those of the text with its ASCII letters in lower case. Others than the
    queries name are left out, as no query reads their lists.
    """
    named = sorted({t for rule in rules for group in trigram_query(rule) for t in group})
    lowered = docs.select(F.col(key).alias("_key"), _ascii_lower(F.col(text)).alias("_text"))
    there = F.array(*[F.when(F.contains(F.col("_text"), F.lit(t)), F.lit(t)) for t in named])
    return lowered.select("_key", F.explode(F.array_compact(there)).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that satisfy a rule's trigram query: ``_key`` and its ``kinds``.

    Postings are intersected by counting: a document has a group of trigrams if it stands
    in as many of their lists as there are. The lists of the queries, whose number is
    that of the rules' trigrams, go to every task; lists of common trigrams are counted
    where they are before they are moved.
    """
    spark = index.sparkSession
    rows = [
        {"kind": rule.kind, "part": number, "trigram": trigram, "needed": len(group)}
        for rule in rules
        for number, group in enumerate(trigram_query(rule))
        for trigram in group
    ]
    queries = literal_rows(spark, rows, "kind:string,part:int,trigram:string,needed:int")
    met = (
        index.join(F.broadcast(queries), "trigram")
        .groupBy("_key", "kind", "part", "needed")
        .agg(F.count_distinct("trigram").alias("_found"))
        .filter(F.col("_found") == F.col("needed"))
    )
    return met.groupBy("_key").agg(F.collect_set("kind").alias("_kinds"))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _told(rows: DataFrame, key: str, listed: DataFrame, most: int) -> DataFrame:
    """The rows with the ``_kinds`` of their key, null where it is no candidate.

    Candidates of up to ``most`` bytes go to every task, and no text moves. Of more, rows and
    candidates meet by a sort-merge join.
    """
    size = F.octet_length(F.struct("_key", "_kinds").cast("string")) + 32
    few = listed.agg(F.coalesce(F.sum(size), F.lit(0)) <= most).first()[0]
    near = F.broadcast(listed) if few else listed.hint("merge")
    return rows.join(near, F.col("_row")[key].eqNullSafe(F.col("_key")), "left")


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """All matches of a rule as an array of (start, kind, end), in code points.

    The texts between matches give the places: a match starts after the matches and
    the texts before it.
    """
    whole = F.transform(F.split(text, rule.pattern, -1), lambda piece: F.char_length(piece))
    length = lambda group: F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), lambda match: F.char_length(match)
    )
    rows = F.arrays_zip(
        F.slice(whole, 1, F.size(whole) - 1).alias("gap"),
        length(0).alias("length"),
        *([length(rule.group).alias("checked")] if rule.group else []),
    )
    span = "struct<start:int,kind:int,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def add(state: Column, row: Column) -> Column:
        begin = state["at"] + row["gap"]
        end = begin + row["length"]
        found = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        enough = row["checked" if rule.group else "length"] >= rule.least
        spans = F.when(enough, F.concat(state["spans"], F.array(found))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    found = F.aggregate(rows, start, add, lambda state: state["spans"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(f"array<{span}>"))


def scanned(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    key: str = "doc_id",
    text: str = "text",
    most_told: int = MOST_TOLD,
) -> DataFrame:
    """Every row with ``_spans``: its secrets as an array of (start, kind, end), sorted.

    ``kind`` is the number of the rule; places count code points of the whole text, the end
    is exclusive. A null text counts as empty and has none. Rows of equal keys, null ones
    too, are candidates together, and each is matched by its own text. An empty table gives
    an empty result. All columns are kept, but one named ``_spans`` is replaced. Candidates
    are listed at once, in a table of the shared folder.
    """
    listed = stored(candidates(postings(docs, rules, key, text), rules), "secrets-candidates")
    # The columns travel in one struct, so that no name of theirs clashes with those in here.
    packed = docs.select(F.struct("*").alias("_row"))
    told = _told(packed, key, listed, most_told)
    body = F.coalesce(F.col("_row")[text], F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for number, rule in enumerate(rules):
        spans = _spans(body, rule, number)
        if trigram_query(rule):
            spans = F.when(F.array_contains(F.col("_kinds"), rule.kind), spans).otherwise(none)
        found.append(spans)
    kept = [F.col("_row")[name].alias(name) for name in docs.columns if name != "_spans"]
    return told.select(*kept, F.array_sort(F.concat(*found)).alias("_spans"))


def spans_text(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    shown = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, shown), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state: Column, span: Column) -> Column:
        before = F.substr(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        added = F.when(span["start"] >= state["at"], F.concat(state["out"], before, F.lit(mark)))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"), added.otherwise(state["out"]).alias("out")
        )

    rest = lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, cut, rest)).otherwise(text)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """The secrets of every whole text of ``documents``: counts, base digest and all spans."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scanned(docs).select("doc_id", "_spans")
    count = lambda n: F.size(F.filter("_spans", lambda s: s["kind"] == n)).cast("long")
    base = spans_text(F.filter("_spans", lambda s: s["kind"] < len(BASE)))
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{rule.kind}") for n, rule in enumerate(BASE)],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("_spans")).alias("spans"),
    )


def _sql_spans(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    checked = f"len(regexp_extract_all(t, '{pattern}', {rule.group})[i]) >= {rule.least}"
    start = (
        "CAST(list_sum(list_transform(p[1:i], lambda x: len(x)))"
        " + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT)"
    )
    return f"""
    SELECT n, i, {number} AS kind, {start} AS s, {start} + len(m[i]) AS e FROM (
      SELECT n, t, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT n, t, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p
        FROM texts WHERE regexp_matches(t, '{pattern}')))
    WHERE {checked}"""


_NAMES = "CASE kind " + " ".join(f"WHEN {n} THEN '{rule.kind}'" for n, rule in enumerate(RULES)) + " END"
_SHOWN = f"string_agg({_NAMES} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
OP3_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_sql_spans(n, rule) for n, rule in enumerate(RULES))}),
shown AS (
  SELECT n, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))},
    coalesce({_SHOWN} FILTER (kind < {len(BASE)}), '') AS base, {_SHOWN} AS spans
  FROM spans GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN shown USING (n)
"""
