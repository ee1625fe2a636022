"""SQL, in DuckDB's dialect, for the rows of those operators that it can express."""

from __future__ import annotations

from sparkclade.llm import embeddings, quality_rules, secrets

_SPACE = r"\x20\x09-\x0D"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _roots(nodes: str, links: str) -> str:
    """roots(a, root): the smallest node that links lead to from each."""
    return f"reach(a, b) AS (SELECT {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON l.a = r.b), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY 1)"


def secret_scan() -> str:
    alphabet = "".join(sorted("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"))
    table = secrets.ratios(*secrets.samples())
    ratio = ", ".join(f"{table[128 * ord(a) + ord(b)]:g}" for a in alphabet for b in alphabet)
    found = []
    for k, kind in enumerate(secrets.KINDS):
        pattern = r"[A-Za-z0-9+/_=-]{20,}" if kind == "markov" else secrets.LONG.get(kind, secrets.PATTERNS[kind][0])
        p = _quote(pattern)
        groups = f", regexp_extract_all(t, {p}, 2) AS g" if kind == "assign" else ", NULL AS g"
        pair = f"r[(strpos({_quote(alphabet)}, substr(m[i], j, 1)) - 1) * {len(alphabet)} + strpos({_quote(alphabet)}, substr(m[i], j + 1, 1))]"
        keep = {
            "assign": f"length(g[i]) >= {secrets.PATTERNS['assign'][2]}",
            "markov": f"regexp_matches(m[i], '[0-9]') AND list_sum(list_transform(range(1, length(m[i])), lambda j: {pair})) >= greatest({secrets.RATIO_TOTAL}, {secrets.RATIO} * length(m[i]))",
        }.get(kind, "true")
        before = "coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        found.append(
            f"SELECT n, {k} AS k, '{kind}' AS kind, CAST({before} AS BIGINT) AS a, CAST({before} + length(m[i]) AS BIGINT) AS b FROM "
            f"(SELECT n, m, gap, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT n, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS gap{groups} FROM texts) WHERE len(m) > 0), ratio WHERE {keep}"
        )
    last = len(secrets.PATTERNS)
    counts = ", ".join(f"count(CASE WHEN k = {k} THEN 1 END) AS n_{kind}" for k, kind in enumerate(secrets.PATTERNS))
    names = "string_agg({0}, ',' ORDER BY a, k, b)"
    one = "kind || ':' || a || ':' || b"
    base = names.format(f"CASE WHEN k < {last} THEN {one} END")
    return f"""WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents), ratio AS (SELECT [{ratio}] AS r),
        spans AS ({' UNION ALL '.join(found)}),
        summed AS (SELECT n, {counts}, sha256(coalesce({base}, '')) AS base_sha256, {names.format(one)} AS spans FROM spans GROUP BY 1)
        SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.PATTERNS)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN summed USING (n)"""


def ngram_jaccard() -> str:
    """Ids must be unique and not null, as those of documents are."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({lower}, '[^{_SPACE}]+') AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h, hash(array_to_string(w[i:i + 4], ' ') || '|') AS h2 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM worded WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.h = y.h AND x.h2 = y.h2 AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
        {_roots('doc_id, doc_id FROM documents', 'links')}
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.root AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN roots r ON r.a = d.doc_id"""


def embedding_dedup() -> str:
    """By comparing all pairs of a label; ids must be unique and not null."""
    return f"""WITH RECURSIVE usable AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        unit AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM usable),
        links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= {embeddings.COSINE}),
        many AS (SELECT a, count(*) AS c FROM links GROUP BY 1),
        {_roots('vec_id, vec_id FROM embeddings', 'links')}
        SELECT v.vec_id, coalesce(c, 0) AS n_links, root AS component_id, v.vec_id = root AS kept FROM embeddings v LEFT JOIN many ON many.a = v.vec_id JOIN roots r ON r.a = v.vec_id"""


def quality() -> str:
    q = quality_rules
    classes = [f"length(t) - length(translate(t, {_quote(letters)}, ''))" for letters in q.CLASSES.values()]
    forms = "w IN (c.word, upper(substr(c.word, 1, 1)) || substr(c.word, 2), upper(c.word))"
    term = "CASE WHEN {0} > 0 THEN {0} * ln(2 * {0} / ({0} + {1})) ELSE 0 END"
    distance = f"sqrt(greatest(0, sum({term.format('p', 'q')} + {term.format('q', 'p')}) / (2 * ln(CAST(2 AS DOUBLE)))))"

    def closest(name: str, own: str, ref: str) -> str:
        return f"{name} AS (SELECT n, min(d) AS d FROM (SELECT o.n, r.lang, {distance} AS d FROM {own} o JOIN {ref} r ON r.bin = o.bin GROUP BY 1, 2) GROUP BY 1)"

    bins = ", ".join(f"({i}, c{i})" for i in range(len(classes)))
    rest = "word_chars - (" + " + ".join(f"c{i}" for i in range(len(classes))) + ")"
    return f"""WITH texts AS (SELECT row_number() OVER () AS n, doc_id, lang, text IS NOT NULL AS there, coalesce(text, '') AS t FROM documents),
        worded AS (SELECT n, regexp_extract_all(t, '[^{_SPACE}]+') AS ws FROM texts),
        words AS (SELECT n, unnest(ws) AS w FROM worded),
        windows AS (SELECT n, i, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT n, ws, unnest(range(1, len(ws) - 1)) AS i FROM worded WHERE len(ws) > 2)),
        again AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, x, y, z) AS c FROM windows) WHERE c > 1),
        repeated AS (SELECT n, count(DISTINCT i + k) AS c FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
        lines AS (SELECT n, count(*) - count(DISTINCT l) AS c FROM (SELECT n, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '[^{_SPACE}]') GROUP BY 1),
        sums AS (SELECT n, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY 1),
        counted AS (SELECT x.n, doc_id, lang, there, coalesce(s.n_words, 0) AS n_words, CAST(coalesce(s.word_chars, 0) AS BIGINT) AS word_chars, coalesce(l.c, 0) AS n_dup_lines, coalesce(r.c, 0) AS n_repeat_words,
          length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, {', '.join(f'{c} AS c{i}' for i, c in enumerate(classes))} FROM texts x LEFT JOIN sums s USING (n) LEFT JOIN lines l USING (n) LEFT JOIN repeated r USING (n)),
        judged AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
        frequent AS (SELECT lang, word, count(*) AS c FROM (SELECT DISTINCT x.n, x.lang, lower(w) AS word FROM words JOIN texts x USING (n) WHERE x.lang IS NOT NULL AND regexp_full_match(w, '\\p{{L}}{{1,{q.LONGEST}}}')) GROUP BY 1, 2),
        common AS (SELECT DISTINCT word FROM (SELECT word, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS r FROM frequent) WHERE r <= {q.COMMON}),
        hits AS (SELECT n, c.word, count(*) AS c FROM words JOIN common c ON {forms} GROUP BY 1, 2),
        chars AS (SELECT j.n, j.lang, j.base_failed, greatest(word_chars, 1) AS total, b.bin, b.c FROM judged j, LATERAL (SELECT * FROM (VALUES {bins}, ({len(classes)}, {rest})) v(bin, c)) b),
        used AS (SELECT n, sum(c) AS c FROM hits GROUP BY 1),
        bags AS (SELECT j.n, j.lang, j.base_failed, greatest(n_words, 1) AS total, c.word AS bin, coalesce(h.c, 0) AS c FROM judged j CROSS JOIN common c LEFT JOIN hits h ON h.n = j.n AND h.word = c.word
          UNION ALL SELECT j.n, j.lang, j.base_failed, greatest(n_words, 1), '', n_words - coalesce(u.c, 0) FROM judged j LEFT JOIN used u ON u.n = j.n),
        total AS (SELECT lang, greatest(sum(word_chars), 1) AS chars, greatest(sum(n_words), 1) AS words FROM judged WHERE NOT base_failed AND lang IS NOT NULL GROUP BY 1),
        charref AS (SELECT lang, bin, sum(c) / CAST(any_value(t.chars) AS DOUBLE) AS q FROM chars JOIN total t USING (lang) WHERE NOT base_failed GROUP BY 1, 2),
        wordref AS (SELECT lang, bin, sum(c) / CAST(any_value(t.words) AS DOUBLE) AS q FROM bags JOIN total t USING (lang) WHERE NOT base_failed GROUP BY 1, 2),
        charown AS (SELECT n, bin, c / CAST(total AS DOUBLE) AS p FROM chars), wordown AS (SELECT n, bin, c / CAST(total AS DOUBLE) AS p FROM bags),
        {closest('chard', 'charown', 'charref')}, {closest('wordd', 'wordown', 'wordref')}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND NOT ((word_chars >= {q.LEAST_CHARS} AND coalesce(a.d, 0) > {q.CHAR_DISTANCE}) OR (n_words >= {q.LEAST_COUNTED} AND coalesce(b.d, 0) > {q.WORD_DISTANCE})) AS kept,
          round(coalesce(a.d, 0), 6) AS char_distance, round(coalesce(b.d, 0), 6) AS word_distance FROM judged j LEFT JOIN chard a USING (n) LEFT JOIN wordd b USING (n)"""
