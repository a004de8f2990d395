"""DuckDB SQL for the operators that SQL can express on whole tables. It shares nothing with their code."""

from __future__ import annotations

WORDS = r"""
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM l)"""

OP4 = f"""
WITH {WORDS.replace("{text}", "text")},
g AS (SELECT doc_id, p, word, count(*) OVER v AS n, string_agg(word, ' ') OVER v AS t FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, p, word, CASE WHEN n = 20 AND row_number() OVER (PARTITION BY n, t ORDER BY doc_id, p) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT doc_id, p, word, max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

OP6 = f"""
WITH RECURSIVE {WORDS.replace("{text}", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
h AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY p) AS next, count(*) OVER (PARTITION BY doc_id) AS k FROM w),
s AS (SELECT DISTINCT doc_id, CASE WHEN k = 1 THEN word ELSE concat(word, ' ', next) END AS sh FROM h WHERE k = 1 OR next IS NOT NULL),
n AS (SELECT doc_id, count(*) AS m FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 80 * (u.m + v.m - c)),
q AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x AS doc_id, x AS root FROM q UNION SELECT q.y, r.root FROM r JOIN q ON q.x = r.doc_id),
o AS (SELECT doc_id, min(root) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.m, 0) AS n_shingles, coalesce(o.c, d.doc_id) AS component_id, coalesce(o.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id"""

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d WHERE len(h) >= 800),
k AS MATERIALIZED (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 800)) AS k FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM k) x WHERE c > 1),
i AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM r),
j AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM i),
a AS (SELECT doc_id, span, min(p) AS low, max(p) + 400 AS high FROM j GROUP BY 1, 2),
b AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS prev FROM a),
z AS (SELECT d.doc_id, max(d.h) AS h, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans, max(high) AS last, string_agg(substring(d.h, 2 * prev + 1, 2 * (low - prev)), '' ORDER BY low) AS head FROM b JOIN d ON d.doc_id = b.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(z.n_removed, 0) AS n_removed, coalesce(z.n_spans, 0) AS n_spans,
sha256(unhex(CASE WHEN z.doc_id IS NULL THEN d.h ELSE concat(z.head, substring(z.h, 2 * z.last + 1)) END)) AS kept_sha256 FROM d LEFT JOIN z ON z.doc_id = d.doc_id"""


def _op10() -> str:
    floor, pairs = (0.05**2, 0.25**2, 0.4**2, 0.35**2), [(i, j) for i in range(1, 5) for j in range(1, i + 1)]
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    ctes = [
        "d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)",
        r"l AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d)",
        "w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM l)",
        "g3 AS (SELECT doc_id, p, word, CASE WHEN lead(word, 2) OVER v IS NOT NULL THEN concat(word, ' ', lead(word, 1) OVER v, ' ', lead(word, 2) OVER v) END AS g FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY p))",
        "r3 AS (SELECT doc_id, p, word, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS again FROM g3)",
        "c3 AS (SELECT doc_id, word, max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM r3)",
        "n3 AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, CAST(sum(hit) AS BIGINT) AS n_repeat_words FROM c3 GROUP BY doc_id)",
        f"q AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x, {blank}) <> '') AS ls, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, lang, source FROM d)",
        "st AS (SELECT q.doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM q LEFT JOIN n3 ON n3.doc_id = q.doc_id)",
        "x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, ln(greatest(word_chars, 1) / CAST(greatest(n_words, 1) AS DOUBLE)) AS x1, ln(1 + 100.0E0 * n_symbols / greatest(word_chars, 1)) AS x2, ln(1 + 100.0E0 * n_dup_lines / greatest(n_words, 1)) AS x3, ln(1 + 20.0E0 * n_repeat_words / greatest(n_words, 1)) AS x4 FROM st)",
        "gc AS (SELECT lang, source, count(*) FILTER (WHERE NOT base_failed) AS c, sum(count(*) FILTER (WHERE NOT base_failed)) OVER (PARTITION BY lang) AS cl FROM x GROUP BY 1, 2)",
        "y AS MATERIALIZED (SELECT x.*, CASE WHEN c >= 20 THEN concat('s|', x.lang, '|', x.source) WHEN cl >= 20 THEN concat('l|', x.lang) ELSE '*' END AS g FROM x JOIN gc ON gc.lang = x.lang AND gc.source = x.source)",
        # documents on the grid, once for each group that they count for
        "e AS MATERIALIZED (SELECT k.g, " + ", ".join(f"round(u.x{i} * 512) AS b{i}, round(u.x{i} * 512) / 512 AS x{i}" for i in range(1, 5)) + " FROM y u JOIN (SELECT DISTINCT g FROM y WHERE NOT base_failed) k ON k.g IN (concat('s|', u.lang, '|', u.source), concat('l|', u.lang), '*') WHERE NOT u.base_failed)",
        "md AS MATERIALIZED (SELECT g, " + ", ".join(f"quantile_cont(b{i}, 0.5) AS c{i}" for i in range(1, 5)) + " FROM e GROUP BY g)",
        "sc AS MATERIALIZED (SELECT e.g, " + ", ".join(f"max(c{i}) / 512 AS m{i}, greatest(1.4826E0 * quantile_cont(abs(b{i} - c{i}), 0.5) / 512, sqrt({floor[i - 1]!r})) AS a{i}" for i in range(1, 5)) + " FROM e JOIN md ON md.g = e.g GROUP BY e.g)",
        "th AS (SELECT e.g, " + ", ".join(f"round(tanh((x{i} - m{i}) / a{i}) * 1024) AS t{i}" for i in range(1, 5)) + " FROM e JOIN sc ON sc.g = e.g)",
        "cv AS (SELECT g, " + ", ".join(f"sum(t{i} * t{j}) / count(*) - sum(t{i}) / count(*) * (sum(t{j}) / count(*)) AS c{i}{j}" for i, j in pairs) + " FROM th GROUP BY g)",
    ]
    means, roots = ", ".join(f"m{i}" for i in range(1, 5)), ", ".join(f"l{i}{j}" for i, j in pairs)

    def moments(name: str, rows: str, keys: str, factor: float) -> None:
        cov = lambda i, j: f"(sum(b{i} * b{j}) / count(*) - sum(b{i}) / count(*) * (sum(b{j}) / count(*))) / 262144 * {factor}"
        ctes.append(f"{name} AS (SELECT {keys}, " + ", ".join(f"sum(b{i}) / count(*) / 512 AS m{i}" for i in range(1, 5)) + ", " + ", ".join((f"greatest({cov(i, j)}, {floor[i - 1]!r})" if i == j else cov(i, j)) + f" AS v{i}{j}" for i, j in pairs) + f" FROM {rows} GROUP BY {keys})")

    def factored(name: str, source: str) -> None:
        """One CTE for each entry of the Cholesky factor."""
        last = source
        for n, (i, j) in enumerate(sorted(pairs, key=lambda p: (p[1], p[0]))):
            rest = f"v{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            entry = f"sqrt(greatest({rest}, {floor[i - 1] / 1e3!r}))" if i == j else f"({rest}) / l{j}{j}"
            here = f"{name}_{n}"
            ctes.append(f"{here} AS (SELECT *, {entry} AS l{i}{j} FROM {last})")
            last = here
        ctes.append(f"{name} AS MATERIALIZED (SELECT *, l11 * l22 * l33 * l44 AS det FROM {last})")

    def scored(name: str, rows: str, estimate: str, s: str = ", o.s") -> None:
        last = f"(SELECT r.*{s}, {means}, {roots} FROM {rows} r JOIN {estimate} o ON o.g = r.g)"
        for i in range(1, 5):
            last = f"(SELECT *, (x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(1, i)) + f") / l{i}{i} AS y{i} FROM {last} t{i})"
        ctes.append(f"{name} AS MATERIALIZED (SELECT *, y1 * y1 + y2 * y2 + y3 * y3 + y4 * y4 AS d2, floor(ln(y1 * y1 + y2 * y2 + y3 * y3 + y4 * y4 + 1e-9) * 256) AS bin FROM {last} t)")

    spread = lambda i: f"sqrt(greatest(c{i}{i}, 1.0))"
    moments("every", "e", "g", 1.0)
    ctes.append("m0 AS (SELECT g, 0 AS s, " + means + ", " + ", ".join(f"a{i} * a{i} AS v{i}{j}" if i == j else f"0.0E0 AS v{i}{j}" for i, j in pairs) + " FROM sc UNION ALL SELECT sc.g, 1, " + means + ", " + ", ".join(f"a{i} * a{i}" if i == j else f"a{i} * a{j} * (c{i}{j} / {spread(i)} / {spread(j)})" for i, j in pairs) + f" FROM sc JOIN cv ON cv.g = sc.g UNION ALL SELECT g, 2, {means}, {', '.join(f'v{i}{j}' for i, j in pairs)} FROM every)")
    factored("f0", "m0")
    # the steps end when no determinant falls; here a fixed number of them, which is more than the groups need
    for step in range(8):
        scored(f"s{step}", "e", f"f{step}")
        ctes.append(f"q{step} AS (SELECT g, s, quantile_cont(bin, 0.75) AS cut FROM s{step} GROUP BY g, s)")
        moments(f"near{step}", f"(SELECT z.* FROM s{step} z JOIN q{step} c ON c.g = z.g AND c.s = z.s WHERE z.bin <= c.cut) h", "g, s", 1.0)
        factored(f"w{step}", f"near{step}")
        better = "true" if step == 0 else "n.det < o.det * (1 - 1e-9)"
        ctes.append(f"f{step + 1} AS MATERIALIZED (SELECT o.g, o.s, " + ", ".join(f"CASE WHEN {better} THEN n.{c} ELSE o.{c} END AS {c}" for c in [*(f"m{i}" for i in range(1, 5)), *(f"l{i}{j}" for i, j in pairs), "det"]) + f" FROM f{step} o JOIN w{step} n ON n.g = o.g AND n.s = o.s)")
    wide = lambda i, j: f"1.4864 * ({' + '.join(f'l{i}{k} * l{j}{k}' for k in range(1, j + 1))})"
    ctes.append(f"raw AS (SELECT g, {means}, " + ", ".join((f"greatest({wide(i, j)}, {floor[i - 1]!r})" if i == j else wide(i, j)) + f" AS v{i}{j}" for i, j in pairs) + " FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY det, s) AS r FROM f8) t WHERE r = 1)")
    factored("rf", "raw")
    scored("rs", "e", "rf", "")
    moments("mw", "(SELECT * FROM rs WHERE d2 <= 11.143) h", "g", 1.0645)
    factored("last", "mw")
    scored("fin", "(SELECT * FROM y WHERE NOT base_failed)", "last", "")
    body = ",\n".join(ctes)
    return f"WITH {body}\nSELECT y.doc_id, y.n_words, y.word_chars, y.n_symbols, y.n_dup_lines, y.n_repeat_words, y.base_failed, coalesce(fin.d2 <= 23.51, false) AS kept FROM y LEFT JOIN fin ON fin.doc_id = y.doc_id"


OP10 = _op10()


_CRC_TABLE = "t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(text: str) -> str:
    """The CRC-32 of an expression's UTF-8 bytes; the CTE ``t`` has the table of one byte."""
    h, digit = f"hex(encode({text}))", lambda i: f"(instr('0123456789ABCDEF', substring({h}, {i}, 1)) - 1)"
    octets = f"list_transform(range(0, len({h}) // 2), lambda i: {digit('2 * i + 1')} * 16 + {digit('2 * i + 2')})"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


OP13 = rf"""
WITH {_CRC_TABLE},
a AS (SELECT doc_id AS id, 1 AS side, text FROM documents UNION ALL SELECT item_id, 2, text FROM benchmark),
l AS (SELECT id, side, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM a),
w AS (SELECT id, side, unnest(ws) AS word FROM l),
k AS MATERIALIZED (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w) q, t),
b AS (SELECT bucket, count(*) FILTER (WHERE side = 1) AS s, count(*) FILTER (WHERE side = 2) AS t FROM w JOIN k ON k.word = w.word GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((s + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM b),
f AS (SELECT id, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM w JOIN k ON k.word = w.word JOIN g ON g.bucket = k.bucket WHERE side = 1 GROUP BY id),
r AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, substring(sha256(concat('2024:', doc_id)), 1, 8) AS h FROM documents LEFT JOIN f ON f.id = doc_id),
z AS (SELECT doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((CAST(list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', substring(h, i, 1)) - 1), lambda x, y: 16 * x + y) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM r),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS want FROM z WHERE n >= 20)
SELECT z.doc_id, n AS n_features, weight, score, CASE WHEN place <= want THEN place END AS rank FROM z LEFT JOIN o ON o.doc_id = z.doc_id"""


OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+') AS ws FROM documents),
r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS run FROM l) q GROUP BY 1, 2),
h AS MATERIALIZED (SELECT run, c, length(run) AS k, {_crc("concat(doc_id, ':', run)")} AS h FROM r, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substring(run, 1, h % k), substring(run, h % k + 2)) ELSE run END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
d AS MATERIALIZED (SELECT word, n, p, concat(substring(word, 1, p), substring(word, p + 2)) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS p FROM v) q),
e AS MATERIALIZED (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest),
o AS (SELECT word, near, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM e),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN o.n >= 2 * v.n THEN near END AS form, CASE WHEN o.n >= 2 * v.n THEN o.n END AS form_n FROM v LEFT JOIN o ON o.word = v.word AND place = 1),
x AS (SELECT word, word AS root FROM f UNION SELECT x.word, f.form FROM x JOIN f ON f.word = x.root WHERE f.form IS NOT NULL),
z AS (SELECT x.word, x.root FROM x JOIN f ON f.word = x.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word"""


OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
n AS MATERIALIZED (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS r FROM v WHERE label IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS p, b.vec_id AS q FROM n a JOIN n b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.r * b.r) >= 0.93),
r AS (SELECT p AS vec_id, q AS root FROM e UNION SELECT r.vec_id, e.q FROM r JOIN e ON e.p = r.root),
o AS (SELECT vec_id, min(root) AS c FROM r GROUP BY vec_id),
k AS (SELECT p AS vec_id, count(*) AS n_links FROM e GROUP BY p)
SELECT d.vec_id, coalesce(n_links, 0) AS n_links, least(coalesce(c, d.vec_id), d.vec_id) AS component_id, coalesce(c, d.vec_id) >= d.vec_id AS kept
FROM embeddings d LEFT JOIN o ON o.vec_id = d.vec_id LEFT JOIN k ON k.vec_id = d.vec_id"""
