"""Quality rules: distribution divergence of whole texts.

Native: DataFrame and SQL functions only.

Counts of every text are taken once: words, symbols, repeated lines, words in
repeated three-word windows, characters by class and common words.  Which words are
common is learnt: of each language of the corpus the words that most of its texts
hold.  The histograms of all texts that pass the base rules, summed by language, are the
references.  A text is dropped if even the closest reference is too far by Jensen-Shannon
distance; a histogram only counts where the text is long enough for it.

A null text counts as empty, has no words and fails the base rules; a null language
makes no reference and has no common words; repeated (tied) rows are judged alike, and take
part in references each; of words in equally many texts the first is taken.  With no
reference the base rules decide; an empty table gives an empty result.  Columns other
than id, text and language are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclade.llm.common import written

SPACE = r"\x20\x09-\x0D"
#: Fewer words than this fail the base rules.
LEAST_WORDS = 50
#: Fewer characters in words than this, and the character histogram isn't judged.
LEAST_CHARS = 200
#: Fewer words than this, and the common-word histogram isn't judged.
LEAST_COUNTED = 150
#: Largest Jensen-Shannon distances (base 2, so at most 1) to the closest reference.
CHAR_DISTANCE = 0.30
WORD_DISTANCE = 0.345

#: Common words of each language, and the longest that are looked at, in code points.
COMMON, LONGEST = 10, 5

# Character classes; what is in none of them is a class of its own.
CLASSES = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "symbol": "#*$%&|<>", "stop": ".,;:", "mark": "!?'\"()-"}


def _strings(words: list[str]) -> str:
    return "cast(array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ") as array<string>)"


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> list[str]:
    """The words, lower-cased, that most texts of each language hold: COMMON of each, letters only, over all texts.

    Only short words are counted, each once for a text, so that what is shuffled stays small."""
    if lang_col is None:
        return []
    from pyspark.sql import Window

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    pattern = rf"(?<![^{SPACE}])\p{{L}}{{1,{LONGEST}}}(?![^{SPACE}])"
    word = F.explode(F.expr(f"array_distinct(transform(regexp_extract_all(t, r'{pattern}', 0), w -> lower(w)))")).alias("word")
    counts = rows.select("lang", word).groupBy("lang", "word").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= COMMON)
    return sorted({r["word"] for r in best.select("word").distinct().collect()})


def counted(docs: DataFrame, common: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts and histograms of every row; `common` is in order of code points."""
    lang = F.col(lang_col) if lang_col else F.lit(None)
    rows = docs.select(F.col(id_col).alias("id"), lang.cast("string").alias("lang"), F.coalesce(text_col, F.lit("")).alias("t"))
    rows = rows.withColumn("trimmed", F.expr(r"trim(both '\t\n\u000b\f\r ' from t)"))
    rows = rows.withColumn("words", F.expr(f"if(trimmed = '', cast(array() as array<string>), split(trimmed, r'[{SPACE}]+'))")).withColumn("n", F.size("words"))
    # A number for each three-word window: hash above, position in the lowest bits, so that sorting brings equal windows together.
    rows = rows.withColumn("bits", F.expr("length(bin(n))")).withColumn("wh", F.expr("transform(words, w -> xxhash64(w))"))
    rows = rows.withColumn("windows", F.expr("if(n < 3, cast(array() as array<bigint>), transform(slice(wh, 1, n - 2), (h, i) -> xxhash64(h, wh[i + 1], wh[i + 2])))"))
    keys = "sort_array(transform(windows, (h, i) -> shiftleft(h, bits) + i))"
    rows = rows.withColumn("keys", F.expr(f"if(size(array_distinct(windows)) = size(windows), cast(array() as array<bigint>), {keys})"))
    same = "shiftright(k, bits) <=> shiftright(get(keys, {0}), bits)"
    found = f"filter(keys, (k, i) -> ({same.format('i - 1')}) or ({same.format('i + 1')}))"
    rows = rows.withColumn("maybe", F.expr(f"transform({found}, k -> cast(k & (shiftleft(1L, bits) - 1) as int))"))
    # Keys of long texts hold few bits of the hash, so what they bring together is compared by all of it.
    rows = rows.withColumn("alike", F.expr("array_sort(transform(maybe, p -> struct(windows[p] as h, p as p)))"))
    again = "(x.h <=> get(alike, i - 1).h) or (x.h <=> get(alike, i + 1).h)"
    rows = rows.withColumn("places", F.expr(f"sort_array(transform(filter(alike, (x, i) -> {again}), x -> cast(x.p as bigint)))"))
    # A repeated window's words, without those that the next repeated window also has.
    repeated = "if(size(places) = 0, 0L, aggregate(zip_with(slice(places, 2, size(places) - 1), slice(places, 1, size(places) - 1), (x, y) -> least(3L, x - y)), 3L, (s, d) -> s + d))"
    rows = rows.withColumn("lines", F.expr("split(t, '\\n')")).withColumn("others", F.size("lines") - F.size(F.array_distinct("lines")))
    rows = rows.withColumn("full", F.expr(f"if(others = 0, cast(array() as array<string>), filter(lines, x -> x rlike r'[^{SPACE}]'))"))
    forms = sorted({f for w in common for f in (w, w.capitalize(), w.upper())})
    rows = rows.withColumn("common", _matching(forms))
    # Each class is counted as what is lost when its characters are taken out of what the classes before have left.
    left, classes = "t", []
    for name, letters in CLASSES.items():
        rows = rows.withColumn(f"less_{name}", F.translate(left, letters, ""))
        classes.append((F.length(left) - F.length(f"less_{name}")).cast("long"))
        left = f"less_{name}"
    return rows.select(
        F.col("id").alias(id_col), "lang",
        F.col("n").cast("long").alias("n_words"),
        F.expr("aggregate(words, 0L, (s, w) -> s + length(w))").alias("word_chars"),
        classes[list(CLASSES).index("symbol")].alias("n_symbols"),
        F.expr("cast(size(full) - size(array_distinct(full)) as bigint)").alias("n_dup_lines"),
        F.expr(repeated).alias("n_repeat_words"),
        F.array(*classes).alias("classes"),
        F.expr(f"transform({_strings(common)}, w -> cast(size(common) - size(array_remove(common, w)) as bigint))").alias("common"),
    )


def _matching(forms: list[str]) -> Column:
    """The words of a text that are among the forms, lower-cased; a set of literals is looked up by hash."""
    if not forms:
        return F.expr("cast(array() as array<string>)")
    return F.transform(F.filter("words", lambda w: w.isin(forms)), F.lower)


def _with_rest(counts: str, total: str) -> str:
    """A histogram as shares, the last for what is in none of the bins."""
    bins = f"concat({counts}, array({total} - aggregate({counts}, 0L, (s, x) -> s + x)))"
    return f"transform({bins}, x -> x / cast(greatest({total}, 1L) as double))"


def distance(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance of two arrays of shares."""
    term = "if({0} > 0, {0} * ln(2 * {0} / ({0} + {1})), 0D)"
    both = f"zip_with({p}, {q}, (x, y) -> {term.format('x', 'y')} + {term.format('y', 'x')})"
    return f"sqrt(greatest(0D, aggregate({both}, 0D, (s, d) -> s + d) / (2 * ln(2D))))"


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(counts: DataFrame, words: int) -> list[tuple[list[float], list[float]]]:
    """(class shares, common-word shares) of each language: a row for each."""
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(words)]
    good = counts.where(~base_failed() & F.col("lang").isNotNull())
    rows = good.groupBy("lang").agg(F.count("*").alias("n"), F.sum("word_chars").alias("chars"), F.sum("n_words").alias("words"), *sums).orderBy(F.desc("n"), "lang").collect()
    out = []
    for r in rows:
        both = []
        for name, size, total in (("c", len(CLASSES), r["chars"]), ("w", words, r["words"])):
            bins = [r[f"{name}{i}"] for i in range(size)]
            both.append([x / max(total, 1) for x in [*bins, total - sum(bins)]])
        out.append((both[0], both[1]))
    return out


def _numbers(values: list[float]) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts of every row, base_failed, distances to the closest reference, and kept."""
    common = common_words(docs, text_col, lang_col)
    counts = written(counted(docs, common, id_col, text_col, lang_col))
    found = references(counts, len(common))
    shares = counts.withColumn("p", F.expr(_with_rest("classes", "word_chars"))).withColumn("q", F.expr(_with_rest("common", "n_words")))
    for name, own, at in (("char_distance", "p", 0), ("word_distance", "q", 1)):
        each = "array(" + ", ".join(_numbers(r[at]) for r in found) + ")"
        shares = shares.withColumn(name, F.expr(f"array_min(transform({each}, r -> {distance(own, 'r')}))") if found else F.lit(0.0))
    far = (F.col("word_chars") >= LEAST_CHARS) & (F.col("char_distance") > CHAR_DISTANCE) | (F.col("n_words") >= LEAST_COUNTED) & (F.col("word_distance") > WORD_DISTANCE)
    return shares.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~far).alias("kept"), "char_distance", "word_distance")
