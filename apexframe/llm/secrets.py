"""Secret scans: fixed patterns, and strings that a character Markov model finds random. Native expressions only.

Two first-order Markov models over character classes are trained from labelled samples: values that the
fixed patterns find (random), and ordinary words (identifiers). A long token whose log-likelihood ratio per
character exceeds a threshold is a span, unless it meets a span of the fixed patterns. Positions come from
the lengths of the matches and of the gaps between them.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.llm.common import in_sample, renamed

# The patterns of the base rules, in their order, with the least length (of group 2 for assign)
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"\b[A-Za-z]{3,}[0-9]{0,4}\b"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LETTERS = 62  # letters and digits; marks that rule lines are drawn with tell nothing
CLASSES = len(ALPHABET) + 1  # any other character is class 0
RATIO = 1.0  # nats per character that a span needs
SAMPLE = 2_000  # documents for each label, about


def _located(pattern: str, keep: str) -> Column:
    """Matches in column ``text`` as array<struct<start, end, value>>; ``keep`` is a condition on x.m, the match."""
    pairs = f"zip_with(slice(split(text, r'{pattern}'), 1, size(m)), m, (g, v) -> named_struct('g', length(g), 'm', v))"
    step = f"""named_struct('at', acc.at + x.g + length(x.m), 'out', if({keep}, concat(acc.out, array(named_struct(
        'start', acc.at + x.g, 'end', acc.at + x.g + length(x.m), 'value', x.m))), acc.out))"""
    none = "named_struct('at', 0, 'out', cast(array() as array<struct<start: int, end: int, value: string>>))"
    body = pairs.replace("size(m)", f"size(regexp_extract_all(text, r'{pattern}', 0))").replace(", m, (g", f", regexp_extract_all(text, r'{pattern}', 0), (g")
    return f"aggregate({body}, {none}, (acc, x) -> {step}, acc -> acc.out)"


def _quoted(pattern: str) -> str:
    """A pattern for a raw SQL literal in single quotes."""
    return pattern.replace("'", r"\x27")


def located(kind: str) -> Column:
    """Spans of a kind in column ``text``, empty where a cheap test finds nothing."""
    empty = "cast(array() as array<struct<start: int, end: int, value: string>>)"
    if kind == "assign":
        pattern = _quoted(ASSIGN)
        keep = f"length(regexp_extract(x.m, r'{pattern}', 2)) >= {LEAST[kind]}"
        test = r"text rlike r'(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]'"
    elif kind == "access":
        pattern, keep, test = ACCESS, f"length(x.m) >= {LEAST[kind]}", "contains(text, 'AKIA')"
    elif kind == "hex":  # runs of the class are maximal, so a shorter run never hides a longer one
        pattern = HEX.replace("+", f"{{{LEAST[kind]},}}")
        keep, test = "true", f"text rlike r'{pattern}'"
    else:
        pattern, keep, test = CANDIDATE, "true", f"text rlike r'{CANDIDATE}'"
    return F.expr(f"if({test}, {_located(pattern, keep)}, {empty})")


def _indexes(value: str) -> str:
    """Character classes of a string, as an array."""
    return f"transform(slice(split({value}, ''), 1, length({value})), c -> instr('{ALPHABET}', c))"


def _transitions(values: DataFrame) -> DataFrame:
    """``values(value)`` -> counts ``(a, b, n)`` of neighbouring classes."""
    pairs = values.select(F.expr(_indexes("value")).alias("i")).where("size(i) > 1")
    pairs = pairs.select(F.explode(F.expr("zip_with(slice(i, 1, size(i) - 1), slice(i, 2, size(i) - 1), (a, b) -> named_struct('a', a, 'b', b))")).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def _probability(counts: DataFrame, uniform: float) -> list[float]:
    """CLASSES x CLASSES probabilities of the next class: counts backed by the classes' own frequencies, mixed
    with a share that is ``uniform``. At most CLASSES squared rows reach the driver."""
    n = {(r.a, r.b): r.n for r in counts.collect()}
    after, of = Counter(), Counter()
    for (a, b), times in n.items():
        after[a] += times
        of[b] += times
    own = [(of[b] + 0.5) / (sum(of.values()) + 0.5 * CLASSES) for b in range(CLASSES)]
    return [(1 - uniform) * (n.get((a, b), 0) + 5 * own[b]) / (after[a] + 5) + uniform / CLASSES for a in range(CLASSES) for b in range(CLASSES)]


def trained(docs: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> list[float]:
    """Log-likelihood ratio of each pair of classes, random over ordinary.

    Random samples are values of the fixed patterns in about ``sample`` documents that may hold some, ordinary
    ones the words of letters, with up to four digits after them, of about ``sample`` documents; in both cases
    those whose id hashes into that share. Without any sample of a label its model is uniform.
    """
    rows = renamed(docs, doc_id=key, text=text).where("text is not null")
    likely = F.expr(r"contains(text, 'AKIA') or text rlike r'[0-9a-f]{16,}|(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]'")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(likely).alias("likely")).first()
    some = rows.where(in_sample("doc_id", sample / max(1, n["likely"]))).where(likely)
    found = some.select(F.explode(F.concat(*[located(k) for k in KINDS[:3]])).alias("s"))
    # of an assignment only the value is random
    random = found.select(F.expr(f"coalesce(nullif(regexp_extract(s.value, r'{_quoted(ASSIGN)}', 2), ''), s.value)").alias("value"))
    words = rows.where(in_sample("doc_id", sample / max(1, n["all"]))).select(F.explode(F.expr(f"regexp_extract_all(text, r'{WORD}', 0)")).alias("value"))
    pairs = zip(_probability(_transitions(random), 0.5), _probability(_transitions(words), 0.001))
    told = [1 <= a <= LETTERS and 1 <= b <= LETTERS for a in range(CLASSES) for b in range(CLASSES)]
    return [math.log(x / y) if use else 0.0 for (x, y), use in zip(pairs, told)]


def spans(docs: DataFrame, ratios: list[float], threshold: float = RATIO, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, base, added)`` for each row: arrays of struct<start, kind, end>, sorted; code points, end exclusive.

    kind is the index in KINDS. Null and empty texts have none. Repeated rows each get a row; an empty table
    gives none. Tokens that meet a base span add nothing.
    """
    rows = renamed(docs, doc_id=key, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    one = lambda kind, found: f"transform({found}, s -> named_struct('start', s.start, 'kind', {KINDS.index(kind)}, 'end', s.end))"
    rows = rows.select("doc_id", *[located(k).alias(k) for k in KINDS])
    base = F.expr(f"array_sort(concat({', '.join(one(k, f'`{k}`') for k in KINDS[:3])}))")
    rows = rows.select("doc_id", base.alias("base"), "markov")
    table = ",".join(f"{x:.6f}" for x in ratios)
    # the table is a constant of the plan: one literal, folded once
    rows = rows.withColumn("ratios", F.split(F.lit(table), ",").cast("array<double>"))
    index = _indexes("s.value")
    score = f"""aggregate(zip_with(slice({index}, 1, length(s.value) - 1), slice({index}, 2, length(s.value) - 1), (a, b) -> a * {CLASSES} + b + 1),
        0D, (acc, i) -> acc + element_at(ratios, i)) > {float(threshold)}D * (length(s.value) - 1)"""
    free = "not exists(base, b -> b.start < s.end and s.start < b.end)"
    added = f"if(size(markov) = 0, markov, filter(markov, s -> {free} and {score}))"
    return rows.select("doc_id", "base", F.expr(one("markov", added)).alias("added"))


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
