"""SQL for a second engine, one text per registered query.

Written from the definitions, not from the plans: translation-memory texts
compare every pair, ranks use one global window.
"""

from __future__ import annotations

import re
from itertools import product

# Fixed values, stated here anew so that a mistake in the engine's own does not pass.
SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SPECIAL_TOKENS = ("<s>", "</s>", "<unk>", "<pad>", "<mask>")
LANGUAGE_CODES = {
    "de": "deu_Latn",
    "en": "eng_Latn",
    "es": "spa_Latn",
    "fr": "fra_Latn",
    "nb": "nob_Latn",
}
SUPPORTED = (
    "('dan_Latn', 'deu_Latn', 'eng_Latn', 'fin_Latn', 'fra_Latn', 'ita_Latn', "
    "'nld_Latn', 'nno_Latn', 'nob_Latn', 'spa_Latn', 'swe_Latn')"
)
ORACLE: dict[str, str] = {}


# --- text expressions ----------------------------------------------------------


def words(c: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{SPACE}+'), lambda q: q <> '')"
    )


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '\\A{SPACE}+|{SPACE}+\\z', '', 'g')"


def bare(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '{SPACE}', '', 'g')"


def tokens_13a(c: str) -> str:
    out = f"coalesce({c}, '')"
    for found, put in (
        ("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"),
        ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"),
    ):
        out = f"replace({out}, {found}, {put})"
    out = f"' ' || {out} || ' '"
    for pattern, put in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    return words(out)


def code(lang: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_CODES.items())
    return f"CASE {lang} {whens} END"


def encode(w: str, lang_code: str) -> str:
    return f"list_concat(list_concat([{lang_code}], ({w})[1:126]), ['</s>'])"


def decode(tokens: str) -> str:
    specials = ", ".join(f"'{t}'" for t in (*SPECIAL_TOKENS, *LANGUAGE_CODES.values()))
    return (
        f"coalesce(array_to_string(list_filter({tokens}, lambda t: t NOT IN ({specials})), ' '), '')"
    )


# --- corpora --------------------------------------------------------------------

CONV = """conv AS (
  SELECT u.conv_id || ':' || u.turn AS pair_id, u.conv_id, u.turn, u.text AS source, a.text AS target
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

LINES = """doc_lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
line_pairs AS (
  SELECT a.doc_id || ':' || a.i AS pair_id, a.doc_id, a.lang, a.line AS source, b.line AS target
  FROM doc_lines a JOIN doc_lines b ON a.doc_id = b.doc_id AND b.i = a.i + 1)"""


def exact(name: str, source: str, key: str) -> str:
    """CTEs for the exact split of ``source``."""
    return f"""{name}_ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || {key}), {key}) AS p,
         ceil((1 - 0.8::DOUBLE) * count(*) OVER ())::BIGINT AS rest,
         count(*) OVER () AS n_all FROM {source}),
{name}_cut AS (
  SELECT *, n_all - rest AS n_train,
         rest - ceil((1 - 0.1::DOUBLE / (0.1::DOUBLE + 0.1::DOUBLE)) * rest)::BIGINT AS n_val
  FROM {name}_ranked),
{name} AS (
  SELECT * EXCLUDE (p, rest, n_all, n_train, n_val),
    CASE WHEN p <= n_train THEN 'train' WHEN p <= n_train + n_val THEN 'val' ELSE 'test' END AS split,
    CASE WHEN p <= n_train THEN p WHEN p <= n_train + n_val THEN p - n_train
         ELSE p - n_train - n_val END AS rk
  FROM {name}_cut)"""


def hashed(key: str) -> str:
    u = f"(('0x' || substr(md5('42:' || {key}), 1, 13))::BIGINT::DOUBLE / {16**13}::DOUBLE)"
    return (
        f"CASE WHEN {u} < 0.8::DOUBLE THEN 'train' "
        f"WHEN {u} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END"
    )


CORPUS = f"{LINES},\n{exact('corpus', 'line_pairs', 'pair_id')}"

RUNS = """runs AS (
  SELECT *, CASE WHEN failed THEN 0.0::DOUBLE ELSE bleu * 100 END AS chrf,
         CASE WHEN failed THEN 999.0::DOUBLE ELSE 1 - bleu END AS loss
  FROM (SELECT event_id AS run_seq,
    CASE WHEN event_id % 6 < 3 THEN '1' WHEN event_id % 6 < 5 THEN '2' ELSE '3' END AS phase,
    [500, 1000, 2000, 3000, 5000, 10000][event_id % 6 + 1]::BIGINT AS data_size,
    [8, 16, 32][user_id % 3 + 1]::INTEGER AS r,
    [16, 32, 64][(user_id // 3) % 3 + 1]::INTEGER AS alpha,
    [0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE][(user_id // 9) % 3 + 1] AS dropout,
    CASE WHEN event_type = 'error' THEN 0.0::DOUBLE
         ELSE floor(least(value, 100.0::DOUBLE) * 0.4::DOUBLE) / 100.0::DOUBLE END AS bleu,
    CASE WHEN event_type = 'error' THEN true END AS failed FROM events)),
valid AS (SELECT * FROM runs WHERE NOT coalesce(failed, false))"""

RECOMMENDED = """best AS (SELECT max(bleu) AS b FROM valid),
rec AS (SELECT
  (CASE WHEN (SELECT b FROM best) > 0 THEN
    (SELECT data_size FROM valid ORDER BY bleu DESC, run_seq LIMIT 1) ELSE 500 END)::BIGINT AS optimal_size,
  (CASE WHEN (SELECT b FROM best) > 0 THEN
    (SELECT min(data_size) FROM valid WHERE bleu >= (SELECT b FROM best) * 0.95::DOUBLE)
    ELSE 500 END)::BIGINT AS recommended_size)"""

STEPS = """steps AS (
  SELECT event_id, event_type AS run, ts, value AS metric,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events)"""


# --- metrics ----------------------------------------------------------------------


def score_ctes(source: str, by: list[str], name: str = "scored", stripped: bool = True,
               per_pair: bool = False) -> str:
    """CTEs that score ``source`` (by..., pair_id, prediction, reference)."""
    keys = [*by, *(["pair_id"] if per_pair else [])]
    clean = strip if stripped else (lambda c: f"coalesce({c}, '')")
    k = "".join(f"{b}, " for b in by)
    kg = "".join(f"{b}, " for b in keys) or ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    on = " AND ".join(f"t.{b} IS NOT DISTINCT FROM m.{b}" for b in keys) or "true"
    wm = ", ".join(f"coalesce(sum(hit) FILTER (kind = 'w' AND n = {n}), 0)::BIGINT AS wm{n}" for n in range(1, 5))
    cm = ", ".join(f"coalesce(sum(hit) FILTER (kind = 'c' AND n = {n}), 0)::BIGINT AS cm{n}" for n in range(1, 7))
    wt = ", ".join(f"sum(greatest(pl - {n - 1}, 0))::BIGINT AS wt{n}" for n in range(1, 5))
    cp = ", ".join(f"sum(CASE WHEN rc >= {n} THEN greatest(pc - {n - 1}, 0) ELSE 0 END)::BIGINT AS cp{n}" for n in range(1, 7))
    cr = ", ".join(f"sum(greatest(rc - {n - 1}, 0))::BIGINT AS cr{n}" for n in range(1, 7))
    prec = {n: f"(CASE WHEN wt{n} > 0 THEN wm{n}::DOUBLE / wt{n} ELSE 0.0::DOUBLE END)" for n in range(1, 5)}
    logs = " + ".join(f"ln(nullif({prec[n]}, 0))" for n in range(1, 5))
    bp = "(CASE WHEN pw > rw THEN 1.0::DOUBLE ELSE exp(1 - rw::DOUBLE / pw) END)"
    low = ", ".join(prec.values())
    bleu = f"CASE WHEN least({low}) > 0 THEN {bp} * exp(({logs}) / 4) ELSE 0.0::DOUBLE END"
    both = {n: f"(cp{n} > 0 AND cr{n} > 0)" for n in range(1, 7)}
    eff = " + ".join(f"(CASE WHEN {both[n]} THEN 1 ELSE 0 END)" for n in range(1, 7))

    def mean(of: str) -> str:
        total = " + ".join(
            f"(CASE WHEN {both[n]} THEN cm{n}::DOUBLE / {of}{n} ELSE 0.0::DOUBLE END)" for n in range(1, 7)
        )
        return f"(CASE WHEN {eff} > 0 THEN ({total}) / ({eff}) ELSE 0.0::DOUBLE END)"

    b = "".join(f", round({prec[n]}, 9) AS bleu_{n}" for n in range(1, 5))
    return f"""{name}_texts AS (
  SELECT {k}pair_id, {tokens_13a(clean('prediction'))} AS p, {tokens_13a(clean('reference'))} AS r,
         {bare('prediction')} AS pt, {bare('reference')} AS rt FROM {source}),
{name}_grams AS (
  SELECT {k}pair_id, 'w' AS kind, 0 AS side, n,
    unnest(list_transform(generate_series(1, len(p) - n + 1), lambda i: array_to_string(p[i:i + n - 1], ' '))) AS gram
  FROM {name}_texts, range(1, 5) AS o(n)
  UNION ALL SELECT {k}pair_id, 'w', 1, n,
    unnest(list_transform(generate_series(1, len(r) - n + 1), lambda i: array_to_string(r[i:i + n - 1], ' ')))
  FROM {name}_texts, range(1, 5) AS o(n)
  UNION ALL SELECT {k}pair_id, 'c', 0, n,
    unnest(list_transform(generate_series(1, length(pt) - n + 1), lambda i: substring(pt, i, n)))
  FROM {name}_texts, range(1, 7) AS o(n)
  UNION ALL SELECT {k}pair_id, 'c', 1, n,
    unnest(list_transform(generate_series(1, length(rt) - n + 1), lambda i: substring(rt, i, n)))
  FROM {name}_texts, range(1, 7) AS o(n)),
{name}_hits AS (
  SELECT {k}pair_id, kind, n, least(sum((side = 0)::INT), sum((side = 1)::INT)) AS hit
  FROM {name}_grams GROUP BY {k}pair_id, kind, n, gram),
{name}_match AS (SELECT {kg}{wm}, {cm} FROM {name}_hits {group}),
{name}_sizes AS (SELECT {k}pair_id, len(p) AS pl, len(r) AS rl, length(pt) AS pc, length(rt) AS rc FROM {name}_texts),
{name}_total AS (
  SELECT {kg}count(*) AS n_segments, sum(pl)::BIGINT AS pw, sum(rl)::BIGINT AS rw, {wt}, {cp}, {cr}
  FROM {name}_sizes {group}),
{name}_sum AS (
  SELECT t.*, m.* EXCLUDE ({', '.join(keys) if keys else 'none_'})
  FROM {name}_total t LEFT JOIN {name}_match m ON {on}),
{name}_chrf AS (SELECT *, {mean('cp')} AS cprec, {mean('cr')} AS crec FROM {name}_sum),
{name} AS (
  SELECT {kg}n_segments, round({bleu}, 9) AS bleu{b},
    round(CASE WHEN cprec + crec > 0 THEN 100 * ((1 + 4.0::DOUBLE) * cprec * crec / (4.0::DOUBLE * cprec + crec))
          ELSE 0.0::DOUBLE END, 9) AS chrf FROM {name}_chrf)""".replace("EXCLUDE (none_)", "")


ALL = "bleu, bleu_1, bleu_2, bleu_3, bleu_4, chrf"


# --- sources ------------------------------------------------------------------------

ORACLE["scan_pairs"] = f"WITH {CONV} SELECT source, target FROM conv"

ORACLE["corpus_stats"] = f"""WITH {CONV},
n AS (SELECT len({words('source')}) AS s, len({words('target')}) AS t FROM conv)
SELECT count(*) AS size, round(coalesce(sum(s)::DOUBLE / count(*), 0), 9) AS avg_source_length,
  round(coalesce(sum(t)::DOUBLE / count(*), 0), 9) AS avg_target_length,
  max(s)::INTEGER AS max_source_length, max(t)::INTEGER AS max_target_length FROM n"""

ORACLE["lang_code_check"] = f"""SELECT lang, {code('lang')} AS code, count(*) AS n_docs,
  coalesce({code('lang')} IN {SUPPORTED}, false) AS known FROM documents GROUP BY lang"""

# --- splits -------------------------------------------------------------------------

DOCS = exact("docs", "(SELECT doc_id FROM documents)", "doc_id")

ORACLE["split_exact"] = f"WITH {DOCS} SELECT doc_id, split, rk FROM docs"
ORACLE["split_counts"] = f"WITH {CORPUS} SELECT split, count(*) AS n FROM corpus GROUP BY split"
ORACLE["split_hash"] = f"SELECT doc_id, {hashed('doc_id')} AS split FROM documents"
ORACLE["split_grouped"] = f"WITH {CONV} SELECT pair_id, conv_id, {hashed('conv_id')} AS split FROM conv"
ORACLE["subset_prefix"] = (
    f"WITH {DOCS} SELECT doc_id, rk FROM docs WHERE split = 'train' AND rk <= 500"
)

SIZES = """sizes AS (
  SELECT * FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7])::BIGINT AS run_seq,
    unnest([500, 1000, 2000, 3000, 5000, 10000,
      least(21059, (SELECT count(*) FROM corpus WHERE split = 'train'))])::BIGINT AS data_size)
  WHERE data_size <= (SELECT count(*) FROM corpus WHERE split = 'train') AND data_size > 0)"""

ORACLE["nested_prefix_stats"] = f"""WITH {CORPUS}, {SIZES},
n AS (SELECT rk, len({words('source')}) AS s, len({words('target')}) AS t FROM corpus WHERE split = 'train')
SELECT run_seq, data_size, count(*) AS n_pairs, sum(s)::BIGINT AS source_words,
  sum(t)::BIGINT AS target_words, max(s)::INTEGER AS max_source_words
FROM sizes JOIN n ON rk <= data_size GROUP BY run_seq, data_size"""

ORACLE["split_leakage"] = f"""WITH {LINES},
s AS (SELECT md5(lower({strip('source')})) AS text_hash, {hashed('pair_id')} AS split FROM line_pairs)
SELECT text_hash, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
  count(*) FILTER (split = 'test') AS n_test
FROM s GROUP BY text_hash HAVING count(DISTINCT split) > 1"""

ORACLE["split_shared_ids"] = f"""WITH {LINES}, s AS (SELECT doc_id, {hashed('pair_id')} AS split FROM line_pairs)
SELECT doc_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
  count(*) FILTER (split = 'test') AS n_test FROM s GROUP BY doc_id HAVING count(DISTINCT split) > 1"""

ORACLE["stored_splits"] = f"""WITH {DOCS}
SELECT doc_id, split, rk, count(*) OVER (PARTITION BY split) AS n_split FROM docs"""

# --- text ---------------------------------------------------------------------------

ORACLE["tokenize_13a"] = f"""WITH t AS (SELECT doc_id, {tokens_13a('text')} AS t FROM documents)
SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(coalesce(array_to_string(t, ' '), '')) AS tokens_md5 FROM t"""

ORACLE["token_normalise"] = f"""WITH w AS (
  SELECT doc_id, length({strip('text')})::INTEGER AS n_chars, {words('text')} AS w, {code('lang')} AS code FROM documents),
e AS (SELECT *, {encode('w', 'code')} AS e FROM w)
SELECT doc_id, n_chars, code, len(w)::INTEGER AS n_words, len(w) > 126 AS was_truncated,
  len(e)::INTEGER AS n_encoded, md5({decode('e')}) AS decoded_md5 FROM e"""



def encoded(source: str) -> str:
    return f"""w AS (SELECT * EXCLUDE (source, target), {code('lang')} AS code, {words('source')} AS s,
  {words('target')} AS t FROM {source}),
enc AS (SELECT * EXCLUDE (s, t), {encode('s', 'code')} AS inp, {encode('t', 'code')} AS lab,
  len(s) > 126 AS it, len(t) > 126 AS lt FROM w)"""


ORACLE["tokenized_pairs"] = f"""WITH {LINES}, {encoded('line_pairs')}
SELECT pair_id, it AS input_truncated, lt AS label_truncated, len(inp)::INTEGER AS n_input,
  len(lab)::INTEGER AS n_label, md5(array_to_string(inp, ' ')) AS input_md5,
  md5(array_to_string(lab, ' ')) AS label_md5 FROM enc"""

# --- batches ------------------------------------------------------------------------

ORACLE["batches"] = f"""WITH {DOCS}
SELECT doc_id, split, ((rk - 1) // 8)::BIGINT AS batch_id, ((rk - 1) % 8)::BIGINT AS place FROM docs"""

BATCHED = f"""{CORPUS}, {encoded('corpus')},
bat AS (SELECT *, ((rk - 1) // 8)::BIGINT AS batch_id FROM enc)"""

ORACLE["padded_batches"] = f"""WITH {BATCHED},
z AS (SELECT *, max(len(inp)) OVER (PARTITION BY split, batch_id)::INTEGER AS width FROM bat)
SELECT pair_id, split, batch_id, width, len(inp)::INTEGER AS n_tokens,
  md5(array_to_string(inp, ' ') || repeat(' <pad>', width - len(inp))) AS padded_md5 FROM z"""

ORACLE["padding_waste"] = f"""WITH {BATCHED},
o AS (SELECT split, batch_id, len(inp) AS n, 'in order' AS strategy FROM bat
  UNION ALL SELECT split, (row_number() OVER (PARTITION BY split ORDER BY len(inp), rk) - 1) // 8, len(inp), 'by length' FROM bat),
b AS (SELECT strategy, split, batch_id, sum(n) AS used, count(*) * max(n) AS total FROM o GROUP BY ALL)
SELECT split, count(*) AS n_batches, sum(used)::BIGINT AS used, sum(total)::BIGINT AS total,
  round((sum(total) - sum(used))::DOUBLE / sum(total), 9) AS waste, strategy FROM b GROUP BY strategy, split"""

ORACLE["label_mask"] = f"""WITH {BATCHED},
i AS (SELECT pair_id, split, batch_id, list_transform(lab, lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT) AS ids FROM bat),
z AS (SELECT *, max(len(ids)) OVER (PARTITION BY split, batch_id)::INTEGER AS width FROM i)
SELECT pair_id, split, width, (width - len(ids))::INTEGER AS n_ignored,
  (list_sum(ids) - 100 * (width - len(ids)))::BIGINT AS sum_masked,
  (list_sum(ids) + (width - len(ids)))::BIGINT AS sum_unmasked FROM z"""

ORACLE["training_schedule"] = f"""WITH {RUNS},
e AS (SELECT run_seq, data_size, least(200, data_size // 4)::BIGINT AS eval_steps,
  least(500, data_size // 2)::BIGINT AS save_steps FROM runs)
SELECT *, (ceil(ceil(data_size / 8.0::DOUBLE) / 2.0::DOUBLE) * 3)::BIGINT AS max_steps,
  round(5e-4::DOUBLE * least(1.0::DOUBLE, (eval_steps - 1) / 100.0::DOUBLE), 9) AS rate_at_eval FROM e"""

# --- metrics ------------------------------------------------------------------------

COPY_CONV = "copied AS (SELECT pair_id, source AS prediction, target AS reference FROM conv)"

ORACLE["corpus_bleu"] = (
    f"WITH {CONV}, {COPY_CONV}, {score_ctes('copied', [])} "
    "SELECT n_segments, bleu, bleu_1, bleu_2, bleu_3, bleu_4 FROM scored"
)
ORACLE["corpus_chrf"] = (
    f"WITH {CONV}, {COPY_CONV}, {score_ctes('copied', [])} SELECT n_segments, chrf FROM scored"
)
ORACLE["segment_scores"] = (
    f"WITH {CONV}, {COPY_CONV}, {score_ctes('copied', [], per_pair=True)} "
    f"SELECT pair_id, {ALL} FROM scored"
)
ORACLE["score_mean_std"] = (
    f"WITH {CONV}, {COPY_CONV}, {score_ctes('copied', [], per_pair=True)} "
    "SELECT round(avg(chrf), 9) AS score_mean, round(stddev_pop(chrf), 9) AS score_std FROM scored"
)
ORACLE["all_metrics"] = (
    f"WITH {LINES}, copied AS (SELECT pair_id, source AS prediction, target AS reference FROM line_pairs), "
    f"{score_ctes('copied', [])} SELECT n_segments, {ALL} FROM scored"
)

ORACLE["corpus_bleu_references"] = f"""WITH {CONV},
t AS (SELECT pair_id, {tokens_13a(strip('target'))} AS p, {tokens_13a(strip('source'))} AS r1,
  {tokens_13a(strip("source || ' ' || target"))} AS r2 FROM conv),
s AS (SELECT pair_id, 0 AS side, p AS u FROM t UNION ALL SELECT pair_id, 1, r1 FROM t UNION ALL SELECT pair_id, 2, r2 FROM t),
g AS (SELECT pair_id, side, n, unnest(list_transform(generate_series(1, len(u) - n + 1),
  lambda i: array_to_string(u[i:i + n - 1], ' '))) AS gram FROM s, range(1, 5) AS o(n)),
h AS (SELECT pair_id, n, gram, sum((side = 0)::INT) AS p,
  greatest(sum((side = 1)::INT), sum((side = 2)::INT)) AS r FROM g GROUP BY ALL),
m AS (SELECT n, sum(least(p, r))::DOUBLE AS m FROM h GROUP BY n),
c AS (SELECT count(*) AS n_segments, sum(len(p)) AS c, sum(least(len(r1), len(r2))) AS r FROM t),
w AS (SELECT n, sum(greatest(len(p) - n + 1, 0)) AS w FROM t, range(1, 5) AS o(n) GROUP BY n),
q AS (SELECT n, CASE WHEN w > 0 THEN m / w ELSE 0.0::DOUBLE END AS q FROM w JOIN m USING (n))
SELECT n_segments, round(CASE WHEN (SELECT min(q) FROM q) > 0 THEN
    (CASE WHEN c > r THEN 1.0::DOUBLE ELSE exp(1 - r::DOUBLE / c) END) * exp((SELECT sum(ln(q)) FROM q) / 4)
    ELSE 0.0::DOUBLE END, 9) AS bleu,
  round((SELECT q FROM q WHERE n = 1), 9) AS bleu_1, round((SELECT q FROM q WHERE n = 2), 9) AS bleu_2,
  round((SELECT q FROM q WHERE n = 3), 9) AS bleu_3, round((SELECT q FROM q WHERE n = 4), 9) AS bleu_4 FROM c"""

ORACLE["metrics_by_slice"] = f"""WITH {LINES},
copied AS (SELECT lang, CASE WHEN len({words('target')}) < 10 THEN 'short'
    WHEN len({words('target')}) < 40 THEN 'medium' ELSE 'long' END AS band, quality,
  pair_id, source AS prediction, target AS reference FROM line_pairs LEFT JOIN labels USING (doc_id)),
{score_ctes('copied', ['lang', 'band', 'quality'])}
SELECT lang, band, quality, n_segments, {ALL} FROM scored"""

ORACLE["masked_metrics"] = f"""WITH {BATCHED},
decoded AS (SELECT split, pair_id, {decode('inp')} AS prediction, {decode('lab')} AS reference FROM bat),
{score_ctes('decoded', ['split'], stripped=False)} SELECT split, n_segments, {ALL} FROM scored"""

ORACLE["all_metrics_scored"] = f"""WITH {LINES}, copied AS (SELECT lang, pair_id, source AS prediction,
  target AS reference, CASE WHEN greatest(length(source), length(target)) > 0 THEN
    least(length(source), length(target))::DOUBLE / greatest(length(source), length(target)) ELSE 1.0::DOUBLE END AS score
  FROM line_pairs), {score_ctes('copied', ['lang'])},
m AS (SELECT lang, round(avg(score), 9) AS score_mean, round(stddev_pop(score), 9) AS score_std FROM copied GROUP BY lang)
SELECT s.lang, n_segments, {ALL}, score_mean, score_std FROM scored s JOIN m ON m.lang IS NOT DISTINCT FROM s.lang"""

ORACLE["mapped_batches"] = """SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
  len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines FROM documents"""

ORACLE["metric_hook"] = f"""WITH {LINES}, copied AS (SELECT lang, pair_id, source AS prediction, target AS reference
  FROM line_pairs), {score_ctes('copied', ['lang'])},
m AS (SELECT lang, round(avg((prediction = reference)::INT), 9) AS exact,
  round(sum(octet_length(encode(prediction)))::DOUBLE / sum(octet_length(encode(reference))), 9) AS length_ratio
  FROM copied GROUP BY lang)
SELECT lang, n_segments, chrf, exact, length_ratio FROM scored JOIN m USING (lang)"""

# --- run tables ---------------------------------------------------------------------

ORACLE["valid_runs"] = f"WITH {RUNS} SELECT * EXCLUDE (failed) FROM valid"
ORACLE["near_best_runs"] = f"""WITH {RUNS} SELECT run_seq, data_size, bleu FROM valid
WHERE bleu >= (SELECT max(bleu) FROM valid) * 0.95::DOUBLE"""
ORACLE["best_size"] = f"""WITH {RUNS} SELECT run_seq, data_size, bleu FROM valid
ORDER BY bleu DESC, run_seq LIMIT 1"""
ORACLE["recommended_size"] = f"WITH {RUNS}, {RECOMMENDED} SELECT * FROM rec"
ORACLE["recommended_size_or_default"] = f"""WITH {RUNS},
b AS (SELECT phase, max(bleu) AS b FROM valid GROUP BY phase),
f AS (SELECT phase, min(data_size) AS s FROM valid JOIN b USING (phase) WHERE bleu >= b * 0.95::DOUBLE GROUP BY phase)
SELECT p.phase, coalesce(s, 2000)::BIGINT AS data_size
FROM (SELECT unnest(['1', '2', '3', '4']) AS phase) p LEFT JOIN f ON f.phase = p.phase"""
ORACLE["best_config"] = f"""WITH {RUNS},
b AS (SELECT r, alpha, dropout, bleu FROM valid ORDER BY bleu DESC, run_seq LIMIT 1)
SELECT * FROM b WHERE bleu > 0
UNION ALL SELECT 16, 32, 0.1::DOUBLE, 0.0::DOUBLE WHERE NOT EXISTS (SELECT 1 FROM b WHERE bleu > 0)"""
ORACLE["run_csv"] = f"""WITH {RUNS} SELECT data_size::INTEGER AS data_size, bleu, chrf, loss, NULL::BOOLEAN AS failed FROM valid"""
ORACLE["stored_recommendation"] = f"""WITH {RUNS}, {RECOMMENDED},
b AS (SELECT r, alpha, dropout FROM valid ORDER BY bleu DESC, run_seq LIMIT 1)
SELECT 'stored' AS kind, recommended_size AS data_size, r, alpha, dropout FROM rec, b
UNION ALL SELECT 'absent', 2000::BIGINT, 16, 32, 0.1::DOUBLE"""
ORACLE["best_config_or_default"] = """SELECT event_id, coalesce((props::JSON ->> 'k')::INTEGER, 16) AS r,
  32 AS alpha, 0.1::DOUBLE AS dropout FROM events"""
ORACLE["summary_rows"] = f"""WITH {RUNS}, {RECOMMENDED}
SELECT run_seq, data_size, bleu, chrf, loss, failed, optimal_size, recommended_size FROM runs, rec"""
ORACLE["all_runs"] = f"WITH {RUNS} SELECT run_seq, phase, data_size, bleu, chrf, loss, failed FROM runs"
ORACLE["runs_with_sentinel"] = f"WITH {RUNS} SELECT run_seq, data_size, bleu, chrf, loss, failed FROM runs"

GATE = """gate AS (SELECT p.phase, count(run_seq) AS attempted, count(*) FILTER (coalesce(failed, false)) AS failed_runs,
  count(run_seq) FILTER (NOT coalesce(failed, false)) AS valid_runs,
  max(bleu) FILTER (NOT coalesce(failed, false)) AS best_bleu,
  count(run_seq) FILTER (NOT coalesce(failed, false)) > 0
    AND coalesce(max(bleu) FILTER (NOT coalesce(failed, false)) >= max(least), true) AS goes_on
FROM (SELECT unnest(['1', '2', '3']) AS phase, unnest([{least}::DOUBLE, NULL, NULL]) AS least) p
LEFT JOIN {runs} x ON x.phase = p.phase GROUP BY p.phase)"""
REACHED = """reached AS (SELECT phase FROM gate g WHERE NOT EXISTS
  (SELECT 1 FROM gate e WHERE e.phase < g.phase AND NOT e.goes_on))"""

ORACLE["phase_gate"] = f"WITH {RUNS}, {GATE.format(least=0.15, runs='runs')} SELECT * FROM gate"
ORACLE["gated_runs"] = f"""WITH {RUNS}, {GATE.format(least=0.15, runs='runs')}, {REACHED}
SELECT run_seq, phase, bleu FROM runs WHERE phase IN (SELECT phase FROM reached)"""
ORACLE["learning_curve"] = f"""WITH {RUNS},
s AS (SELECT data_size, count(*) AS n_runs, max(bleu) AS bleu, max(chrf) AS chrf FROM valid GROUP BY data_size)
SELECT *, round(bleu - lag(bleu) OVER (ORDER BY data_size), 9) AS bleu_gain,
  round(chrf - lag(chrf) OVER (ORDER BY data_size), 9) AS chrf_gain FROM s"""
ORACLE["param_grid"] = f"""WITH {RUNS},
g AS (SELECT a.r, b.alpha, c.dropout, row_number() OVER (ORDER BY a.r, b.alpha, c.dropout) AS setting
  FROM (SELECT unnest([8, 16, 32])::INTEGER AS r) a, (SELECT unnest([16, 32, 64])::INTEGER AS alpha) b,
       (SELECT unnest([0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS dropout) c),
t AS (SELECT r, alpha, dropout, count(*) AS n_runs FROM runs GROUP BY ALL)
SELECT setting, r, alpha, dropout, 'experiments/param_r' || r || '_a' || alpha || '_d' || dropout AS folder,
  coalesce(n_runs, 0) AS n_runs FROM g LEFT JOIN t USING (r, alpha, dropout)"""
ORACLE["param_impact"] = f"""WITH {RUNS}
SELECT 'r' AS parameter, r::DOUBLE AS value, count(*) AS n_runs, round(avg(bleu), 9) AS mean_bleu FROM valid GROUP BY r
UNION ALL SELECT 'alpha', alpha::DOUBLE, count(*), round(avg(bleu), 9) FROM valid GROUP BY alpha
UNION ALL SELECT 'dropout', dropout, count(*), round(avg(bleu), 9) FROM valid GROUP BY dropout"""
ORACLE["param_pivot"] = f"""WITH {RUNS} SELECT r, round(avg(bleu) FILTER (alpha = 16), 9) AS alpha_16,
  round(avg(bleu) FILTER (alpha = 32), 9) AS alpha_32, round(avg(bleu) FILTER (alpha = 64), 9) AS alpha_64
FROM valid GROUP BY r"""
ORACLE["metric_log_long"] = f"""WITH {RUNS} SELECT run_seq AS run_id, data_size AS step, 'bleu' AS metric, bleu AS value FROM runs
UNION ALL SELECT run_seq, data_size, 'chrf', chrf FROM runs UNION ALL SELECT run_seq, data_size, 'loss', loss FROM runs"""
ORACLE["report_rows"] = f"""WITH {RUNS} SELECT run_seq, 'PHASE ' || phase AS label, data_size::VARCHAR AS size_text,
  printf('%.4f', bleu) AS bleu_text, printf('%.4f', chrf) AS chrf_text FROM runs"""

# --- metric logs --------------------------------------------------------------------

MEANS = f"""{STEPS}, means AS (
  SELECT run, max(step) AS step, round(avg(metric), 9) AS metric FROM steps GROUP BY run, (step - 1) // 50)"""

ORACLE["logged_means"] = f"WITH {MEANS} SELECT run, step, metric FROM means"
ORACLE["best_checkpoint"] = f"""WITH {MEANS},
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, step) = 1 AS is_best,
  row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 2 AS is_last FROM means)
SELECT run, step, metric, is_best FROM r WHERE is_best OR is_last"""
ORACLE["early_stop_step"] = f"""WITH {STEPS},
b AS (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM steps),
i AS (SELECT *, max(CASE WHEN before IS NULL OR metric > before THEN step END) OVER (PARTITION BY run ORDER BY step) AS last FROM b)
SELECT run, count(*) AS n_steps, min(step) FILTER (step - last >= 3) AS stop_step,
  arg_min(greatest(before, metric), step) FILTER (step - last >= 3) AS best_at_stop FROM i GROUP BY run"""
ORACLE["running_best"] = f"""WITH {STEPS} SELECT event_id, run, max(metric) OVER (PARTITION BY run ORDER BY step) AS best_so_far FROM steps"""
ORACLE["metric_windows"] = """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS run, count(*) AS n,
  round(avg(value), 9) AS metric_mean, max(value) AS metric_max FROM events GROUP BY 1, 2"""
ORACLE["stream_metric_windows"] = ORACLE["metric_windows"]
ORACLE["stream_metric_log"] = "SELECT event_id, event_type AS run, ts, value AS metric FROM events"
ORACLE["stream_best_per_run"] = """SELECT run, event_id, metric FROM (
  SELECT event_type AS run, event_id, value AS metric,
    row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS i FROM events) WHERE i = 1"""

# --- translation memory -------------------------------------------------------------


def overlaps(queries: str, orders: tuple[int, ...] = (1,), memory: str = "split = 'train'") -> str:
    """CTE ``pairs`` with the overlap of every query and memory pair that share a gram."""
    return f"""toks AS (SELECT pair_id, split, rk, {words('source')} AS w FROM corpus),
grams AS (SELECT DISTINCT pair_id, split, rk, n, unnest(list_transform(generate_series(1, len(w) - n + 1),
    lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM toks, (SELECT unnest({list(orders)}) AS n)),
counts AS (SELECT pair_id, n, count(*) AS c FROM grams GROUP BY ALL),
shared AS (SELECT q.pair_id, q.n, m.pair_id AS mid, m.rk, count(*) AS k FROM grams q JOIN grams m ON q.g = m.g AND q.n = m.n
  WHERE q.{queries} AND m.{memory} GROUP BY ALL),
pairs AS (SELECT s.pair_id, s.n, s.rk, s.k, a.c AS na, b.c AS nb FROM shared s
  JOIN counts a ON a.pair_id = s.pair_id AND a.n = s.n JOIN counts b ON b.pair_id = s.mid AND b.n = s.n)"""


def matched(queries: str, sim: str = "k::DOUBLE / (na + nb - k)", keep: str = "true") -> str:
    """CTE ``pred``: the best match of every query among ``pairs``, empty where there is none."""
    return f"""near AS (SELECT *, {sim} AS sim FROM pairs),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY sim DESC, rk) AS i
  FROM near WHERE {keep}) WHERE i = 1),
pred AS (SELECT q.split, q.pair_id, q.rk, t.rk AS match_rk, t.sim, coalesce(m.target, '') AS prediction, q.target AS reference
  FROM corpus q LEFT JOIN top t ON t.pair_id = q.pair_id
  LEFT JOIN corpus m ON m.split = 'train' AND m.rk = t.rk WHERE q.{queries})"""


def renamed(ctes: str, suffix: str) -> str:
    """The same CTEs under other names, so that two searches fit into one query."""
    own = "toks|grams|counts|shared|pairs|near|top|pred|settings|hits|lost"
    return re.sub(rf"\b({own})\b", rf"\1_{suffix}", ctes)


TEST = "split = 'test'"
TEST_PRED = f"{CORPUS}, {overlaps(TEST)}, {matched(TEST)}"

ORACLE["tm_predict"] = f"""WITH {TEST_PRED}
SELECT pair_id, match_rk, round(sim, 9) AS similarity, prediction FROM pred"""
ORACLE["tm_predict_any"] = f"""WITH {TEST_PRED}
SELECT pair_id, match_rk, round(sim, 9) AS similarity, prediction,
  (SELECT count(*) FILTER (match_rk IS NULL) FROM pred) AS n_unmatched FROM pred"""
ORACLE["test_evaluation"] = f"""WITH {TEST_PRED}, {score_ctes('pred', ['split'])}
SELECT split, n_segments, {ALL} FROM scored"""
ORACLE["sample_predictions"] = f"""WITH {TEST_PRED}
SELECT rk, prediction, reference FROM pred ORDER BY rk LIMIT 10"""
ORACLE["baseline_comparison"] = f"""WITH {TEST_PRED},
sys AS (SELECT 'memory' AS system, pair_id, prediction, reference FROM pred
  UNION ALL SELECT 'copy', pair_id, source, target FROM corpus WHERE split = 'test'),
{score_ctes('sys', ['system'])},
alike AS (SELECT system, round(avg(CASE WHEN greatest(length(prediction), length(reference)) > 0 THEN
    least(length(prediction), length(reference))::DOUBLE / greatest(length(prediction), length(reference))
    ELSE 1.0::DOUBLE END), 9) AS score FROM sys GROUP BY system),
both_ AS (SELECT * FROM scored JOIN alike USING (system)),
b AS (SELECT * FROM both_ WHERE system = 'copy'), f AS (SELECT * FROM both_ WHERE system = 'memory')
SELECT 'BLEU' AS label, b.bleu AS baseline, f.bleu AS final, round(f.bleu - b.bleu, 9) AS gain FROM b, f
UNION ALL SELECT 'CHRF', b.chrf, f.chrf, round(f.chrf - b.chrf, 9) FROM b, f
UNION ALL SELECT 'SCORE_MEAN', b.score, f.score, round(f.score - b.score, 9) FROM b, f"""

_SWEEP = f"""{SIZES}, {overlaps("split = 'val'")},
near AS (SELECT *, k::DOUBLE / (na + nb - k) AS sim FROM pairs),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_seq, pair_id ORDER BY sim DESC, rk) AS i
  FROM near JOIN sizes ON rk <= data_size) WHERE i = 1),
pred AS (SELECT s.run_seq, q.pair_id, t.rk AS match_rk, coalesce(t.sim, 0.0::DOUBLE) AS sim,
    coalesce(m.target, '') AS prediction, q.target AS reference
  FROM (SELECT * FROM corpus WHERE split = 'val') q CROSS JOIN sizes s
  LEFT JOIN top t ON t.pair_id = q.pair_id AND t.run_seq = s.run_seq
  LEFT JOIN corpus m ON m.split = 'train' AND m.rk = t.rk),
{score_ctes('pred', ['run_seq'], 'swept')},
lost AS (SELECT run_seq, round(1 - sum(sim) / count(*), 9) AS loss, count(match_rk) AS n_matched FROM pred GROUP BY run_seq),
sweep AS (SELECT run_seq, data_size, n_matched, bleu, chrf, loss FROM sizes JOIN swept USING (run_seq) JOIN lost USING (run_seq))"""
SWEEP = f"{CORPUS}, {_SWEEP}"

ORACLE["scaling_sweep"] = f"WITH {SWEEP} SELECT * FROM sweep"
ORACLE["scaling_sweep_any"] = ORACLE["scaling_sweep"]


def phased(least: float) -> str:
    return f"""WITH {SWEEP},
ph AS (SELECT *, CASE WHEN run_seq <= 3 THEN '1' WHEN run_seq <= 5 THEN '2' ELSE '3' END AS phase, false AS failed FROM sweep),
{GATE.format(least=least, runs='ph')}, {REACHED}
SELECT run_seq, phase, data_size, bleu, chrf FROM ph WHERE phase IN (SELECT phase FROM reached)"""


ORACLE["phased_sweep"] = phased(0.15)
ORACLE["phased_sweep_stopped"] = ORACLE["phased_sweep"]
ORACLE["phased_sweep_passed"] = phased(0.1)
ORACLE["summary_document"] = f"""WITH {SWEEP}, valid AS (SELECT * FROM sweep), {RECOMMENDED}
SELECT optimal_size, recommended_size, (SELECT string_agg(printf('%d %.9f %.9f %.9f', data_size, bleu, chrf, loss), chr(10)
  ORDER BY run_seq) FROM sweep) AS all_results FROM rec"""

_SETTINGS = ", ".join(
    f"({i + 1}, {n}, {b}::DOUBLE, {f}::DOUBLE)"
    for i, (n, b, f) in enumerate(product((1, 2, 3), (0.5, 1.0, 2.0), (0.3, 0.5, 0.7)))
)
_WEIGHTED = "((1 + beta * beta) * k) / (beta * beta * na + nb)"

_GRID = f"""{overlaps("split = 'val'", (1, 2, 3))},
settings AS (SELECT * FROM (VALUES {_SETTINGS}) AS v(setting, gram_order, beta, min_similarity)),
near AS (SELECT setting, pair_id, rk, {_WEIGHTED} AS sim, min_similarity
  FROM pairs JOIN settings ON gram_order = n),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setting, pair_id ORDER BY sim DESC, rk) AS i
  FROM near WHERE sim >= min_similarity) WHERE i = 1),
pred AS (SELECT s.setting, q.pair_id, t.rk AS match_rk, coalesce(m.target, '') AS prediction, q.target AS reference
  FROM (SELECT * FROM corpus WHERE split = 'val') q CROSS JOIN settings s
  LEFT JOIN top t ON t.pair_id = q.pair_id AND t.setting = s.setting
  LEFT JOIN corpus m ON m.split = 'train' AND m.rk = t.rk),
{score_ctes('pred', ['setting'], 'rated')},
hits AS (SELECT setting, count(match_rk) AS n_matched FROM pred GROUP BY setting),
grid AS (SELECT setting, gram_order, beta, min_similarity, n_matched, bleu, chrf
  FROM settings JOIN rated USING (setting) JOIN hits USING (setting))"""

ORACLE["param_sweep"] = f"WITH {CORPUS}, {_GRID} SELECT * FROM grid"

_CHOSEN = _WEIGHTED.replace("beta", "(SELECT beta FROM chosen)")

ORACLE["final_result"] = f"""WITH {CORPUS}, {renamed(_SWEEP, 'sizes')},
valid AS (SELECT * FROM sweep), {RECOMMENDED}, {renamed(_GRID, 'grid')},
chosen AS (SELECT gram_order, beta, min_similarity FROM grid ORDER BY bleu DESC, setting LIMIT 1),
{overlaps("split <> 'train'", (1, 2, 3), "split = 'train' AND m.n = (SELECT gram_order FROM chosen) AND m.rk <= (SELECT recommended_size FROM rec)")},
{matched("split <> 'train'", _CHOSEN, "sim >= (SELECT min_similarity FROM chosen)")},
{score_ctes('pred', ['split'])},
s AS (SELECT string_agg(prediction, chr(10) || '--' || chr(10) ORDER BY rk) AS sample_predictions,
  string_agg(reference, chr(10) || '--' || chr(10) ORDER BY rk) AS sample_references
  FROM (SELECT * FROM pred WHERE split = 'test' ORDER BY rk LIMIT 10))
SELECT v.bleu AS validation_bleu, v.chrf AS validation_chrf, t.bleu AS test_bleu, t.chrf AS test_chrf,
  gram_order, beta, min_similarity, recommended_size AS data_size, sample_predictions, sample_references
FROM scored v, scored t, chosen, rec, s WHERE v.split = 'val' AND t.split = 'test'"""

# --- lexical table ------------------------------------------------------------------

LEXICON = f"""{CONV}, hp AS (SELECT *, {hashed('pair_id')} AS split FROM conv),
sw AS (SELECT pair_id, w AS s, count(*) AS cs FROM (SELECT pair_id, unnest({words('source')}) AS w
  FROM hp WHERE split = 'train') GROUP BY ALL),
tw AS (SELECT pair_id, w AS t, count(*) AS ct FROM (SELECT pair_id, unnest({words('target')}) AS w
  FROM hp WHERE split = 'train') GROUP BY ALL),
co AS (SELECT pair_id, s, t, cs, ct FROM sw JOIN tw USING (pair_id)),
len AS (SELECT pair_id, sum(cs) AS l FROM sw GROUP BY pair_id),
c1 AS (SELECT s, t, sum(ct * cs / l::DOUBLE) AS c, count(*) AS n_pairs FROM co JOIN len USING (pair_id) GROUP BY s, t),
p1 AS (SELECT s, t, n_pairs, c / sum(c) OVER (PARTITION BY s) AS prob FROM c1),
z2 AS (SELECT pair_id, t, sum(cs * prob) AS z FROM co JOIN p1 USING (s, t) GROUP BY ALL),
c2 AS (SELECT s, t, sum(ct * cs * prob / z) AS c FROM co JOIN p1 USING (s, t) JOIN z2 USING (pair_id, t) GROUP BY s, t),
p2 AS (SELECT s, t, c / sum(c) OVER (PARTITION BY s) AS prob FROM c2),
z3 AS (SELECT pair_id, t, sum(cs * prob) AS z FROM co JOIN p2 USING (s, t) GROUP BY ALL),
c3 AS (SELECT s, t, sum(ct * cs * prob / z) AS c, count(*) AS n_pairs FROM co JOIN p2 USING (s, t) JOIN z3 USING (pair_id, t) GROUP BY s, t),
lex AS (SELECT s, t, n_pairs, round(c / sum(c) OVER (PARTITION BY s), 9) AS prob FROM c3)"""

ORACLE["lexical_table"] = f"WITH {LEXICON} SELECT s, t, n_pairs, prob FROM lex"
ORACLE["lexical_predict"] = f"""WITH {LEXICON},
top AS (SELECT s, t FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY prob DESC, t) AS i FROM lex) WHERE i = 1),
q AS (SELECT pair_id, unnest({words('source')}) AS s, generate_subscripts({words('source')}, 1) AS i FROM hp WHERE split = 'test')
SELECT h.pair_id, coalesce(string_agg(coalesce(t, q.s), ' ' ORDER BY i), '') AS prediction
FROM (SELECT pair_id FROM hp WHERE split = 'test') h LEFT JOIN q ON q.pair_id = h.pair_id
LEFT JOIN top ON top.s = q.s GROUP BY h.pair_id"""
