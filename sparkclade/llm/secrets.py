"""Secret scans: fixed patterns, and character Markov models of long tokens.

Native: DataFrame and SQL functions only.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are trained on labelled samples.  A long token with a digit
whose log-likelihood ratio says random is a span, besides those of the patterns.

Positions are in code points, ends exclusive.  They follow from the lengths of the
matches and of the text between them.  A null text counts as empty and has no spans (and
stays null where texts are redacted); rows are independent of each other, so repeated ones
get equal results; spans that begin alike are in the order of KINDS; an empty table gives an
empty result; other columns may have any name.  The time a text takes is in proportion to its
length, however long a token in it is.
"""

from __future__ import annotations

import keyword
import math
import random
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns, and which group must have how many characters.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: A text that none of these is found in has no span of the kind; they are cheaper to search for.
HINTS = {"assign": PATTERNS["assign"][0], "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: What the patterns come to where failing matches need not be cut out: the same spans, found faster.
LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}+"
KINDS = [*PATTERNS, "markov"]
#: Least log-likelihood ratio (natural) for each character of a token, and in all.
RATIO, RATIO_TOTAL = 0.6, 14.0
#: Matches whose positions are summed up at once.
RUN = 128


def samples(count: int = 4000, seed: int = 7) -> tuple[list[str], list[str]]:
    """Labelled samples: (random strings, ordinary identifiers), alike for every run."""
    rng = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [lower + upper + digit, lower + upper + digit + "+/", lower + upper + digit + "_-", upper + digit, lower + digit]
    secret = ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 48))) for i in range(count)]
    words = sorted({w for name in [*sys.stdlib_module_names, *keyword.kwlist, *dir(str), *dir(int), *dir(list), *dir(dict), *dir(math), *dir(sys)] for w in name.lower().strip("_").split("_") if w.isalpha()})
    plain = []
    for i in range(count):
        some = [rng.choice(words) for _ in range(rng.randint(2, 5))]
        number = str(rng.randint(0, 10 ** rng.randint(1, 4)))
        form = i % 6
        if form == 0:
            plain.append("_".join([*some, number]))
        elif form == 1:
            plain.append("-".join([*some, number]))
        elif form == 2:
            plain.append("".join(w.capitalize() for w in some) + number)
        elif form == 3:
            plain.append("/".join([*some, number]))
        elif form == 4:
            plain.append("_".join(some).upper())
        else:
            plain.append(f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}-" + "-".join(some))
        plain.append("".join(rng.choice(digit) for _ in range(rng.randint(4, 12))) if i % 4 == 0 else "".join(some))
    return secret, plain


def ratios(secret: list[str], plain: list[str]) -> list[float]:
    """Log ratio of the two models' transition probabilities, at 128 * previous + current."""
    chars = sorted(set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"))
    models = []
    for texts in (secret, plain):
        pairs = {(a, b): 0.5 for a in chars for b in chars}
        for t in texts:
            for a, b in zip(t, t[1:]):
                if (a, b) in pairs:
                    pairs[a, b] += 1
        total = {a: sum(pairs[a, b] for b in chars) for a in chars}
        models.append({k: math.log(n / total[k[0]]) for k, n in pairs.items()})
    table = [0.0] * (128 * 128)
    for a in chars:
        for b in chars:
            table[128 * ord(a) + ord(b)] = round(models[0][a, b] - models[1][a, b], 4)
    return table


_TABLE: list[str] = []


def _table() -> str:
    """The table as SQL: a cast of one string, folded into a constant when the query is planned."""
    if not _TABLE:
        _TABLE.append("cast(split('" + ",".join(f"{v:g}" for v in ratios(*samples())) + "', ',') as array<double>)")
    return _TABLE[0]


def _ratio(token: str) -> str:
    """The sum over all neighbouring characters, in one pass over them."""
    step = "named_struct('last', ascii(c), 'sum', s.sum + if(s.last = 0, 0D, ratio[128 * s.last + ascii(c)]))"
    return f"aggregate(split({token}, ''), named_struct('last', 0, 'sum', 0D), (s, c) -> {step}, s -> s.sum)"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: str) -> str:
    """SQL for the spans of a kind in t: array<struct<start, k, end>>."""
    number = KINDS.index(kind)
    pattern = TOKEN if kind == "markov" else LONG.get(kind, PATTERNS[kind][0])
    p = _literal(pattern)
    length = "length(m[i])"
    if kind == "markov":
        # Every match carries its ratio; those that say random are kept.
        keep = f"{_ratio('m[i]')} >= greatest({RATIO_TOTAL}D, {RATIO}D * {length})"
    elif kind in LONG:
        keep = "true"
    else:
        keep = f"length(g[i]) >= {PATTERNS[kind][2]}"
    one = "named_struct('start', at, 'k', {0}, 'end', at + {1})".format(number, length).replace("at", "(r.at + length(gap[i]))")
    inner = (
        "aggregate(sequence(b * {run}, least(size(m) - 1, b * {run} + {run} - 1)), named_struct('at', a.at, 'out', cast(array() as {type})), "
        "(r, i) -> named_struct('at', r.at + length(gap[i]) + {length}, 'out', if({keep}, concat(r.out, array({one})), r.out)))"
    ).format(run=RUN, length=length, keep=keep, one=one, type=_SPANS)
    outer = (
        f"flatten(aggregate(sequence(0, (size(m) - 1) div {RUN}), named_struct('at', 0, 'out', cast(array() as array<{_SPANS}>)), "
        f"(a, b) -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(a.out, array(r.out))))[0], a -> a.out))"
    )
    return outer, p


_SPANS = "array<struct<start:int,k:int,end:int>>"


def with_spans(texts: DataFrame) -> DataFrame:
    """texts, which has no columns but its own (in0, in1 and so on, and t), with `spans`: all spans of t, by start, then kind as listed."""
    rows = texts
    for kind in KINDS:
        outer, p = _spans(kind)
        hint = _literal(HINTS.get(kind, TOKEN))
        rows = rows.withColumn("hit", F.expr(f"t rlike {hint}" if kind != "access" else f"contains(t, 'AKIA') and t rlike {hint}"))
        found = [f"'m', regexp_extract_all(t, {p}, 0)", f"'gap', split(t, {p}, -1)"]
        if kind == "assign":
            found.append(f"'g', regexp_extract_all(t, {p}, 2)")
        if kind == "markov":
            found.append(f"'ratio', {_table()}")
        body = outer
        for name in ("m", "gap", "g", "ratio"):
            body = _qualified(body, name)
        # A struct bound by transform() is made once, however often the lambda names it.
        rows = rows.withColumn(f"of_{kind}", F.expr(f"if(hit, transform(array(named_struct({', '.join(found)})), x -> {body})[0], cast(array() as {_SPANS}))"))
    together = F.array_sort(F.concat(*(f"of_{k}" for k in KINDS)))
    return rows.withColumn("spans", together).drop("hit", *(f"of_{k}" for k in KINDS))


def _qualified(sql: str, name: str) -> str:
    import re

    return re.sub(rf"(?<![A-Za-z_.']){name}(?=\[|\))", f"x.{name}", sql)


def _names(spans: str) -> str:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({kinds}[s.k], ':', s.start, ':', s.end)), ',')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = with_spans(docs.select(F.col(id_col).alias("in0"), F.coalesce(text_col, F.lit("")).alias("t")))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    base = F.expr(f"sha2({_names(f'filter(spans, s -> s.k < {len(PATTERNS)})')}, 256)").alias("base_sha256")
    return found.select(F.col("in0").alias(id_col), *counts, base, F.expr(_names("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with all spans of the text replaced by a mark; overlapping spans by one.

    Columns keep their names and places, whatever they are called."""
    names = docs.columns
    own = f"in{names.index(text_col)}"
    rows = with_spans(docs.toDF(*(f"in{i}" for i in range(len(names)))).withColumn("t", F.coalesce(own, F.lit(""))))
    piece = "substring(t, p.to + 1, s.start - p.to)"
    step = f"if(s.start >= p.to, named_struct('to', s.end, 'out', concat(p.out, array({piece}))), named_struct('to', greatest(p.to, s.end), 'out', p.out))"
    clean = f"aggregate(spans, named_struct('to', 0, 'out', cast(array() as array<string>)), (p, s) -> {step}, p -> concat(array_join(p.out, '{mark}'), '{mark}', substring(t, p.to + 1)))"
    rows = rows.withColumn(own, F.expr(f"if(size(spans) = 0, {own}, {clean})"))
    return rows.select(*(f"in{i}" for i in range(len(names)))).toDF(*names)
