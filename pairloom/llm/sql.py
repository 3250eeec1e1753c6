"""SQL of registered queries for a second engine, written from the definitions."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def crc32(value: str) -> str:
    """Unsigned CRC-32 of the text of a number, bit by bit."""
    return f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)))"""


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


# --- Merkle manifest ------------------------------------------------------------------


def _field(value: str) -> str:
    return (
        f"coalesce(octet_length(encode(CAST({value} AS VARCHAR)))::VARCHAR || ':' || "
        f"CAST({value} AS VARCHAR), '-')"
    )


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, source: str, depth: int) -> str:
    """Levels of the trees (t, pos, h) in ``source``: eight in a row until one remains."""
    out = f"{name}0 AS (SELECT t, pos, h, count(*) OVER (PARTITION BY t) AS n FROM {source})"
    for k in range(depth):
        out += f""",
{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM (
  SELECT t, pos // 8 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h
  FROM {name}{k} GROUP BY t, pos // 8))"""
    return out


def _folds(name: str, levels: str, source: str, depth: int) -> str:
    """Folding of (id, t, pos, acc, proof, ...) along the levels."""
    out = f"{name}0 AS (SELECT * FROM {source})"
    for k in range(depth):
        out += f""",
{name}s{k} AS (SELECT f.id, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < f.pos), '') AS l,
  coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > f.pos), '') AS r, max(s.n) AS n
  FROM {name}{k} f JOIN {levels}{k} s ON s.t = f.t AND s.pos // 8 = f.pos // 8 GROUP BY f.id),
{name}{k + 1} AS (SELECT f.* REPLACE (f.pos // 8 AS pos, f.proof || l || r AS proof,
    CASE WHEN n > 1 THEN sha256(l || f.acc || r) ELSE f.acc END AS acc)
  FROM {name}{k} f JOIN {name}s{k} USING (id))"""
    return out


_DEEP, _WIDE = 7, 3

MERKLE = f"""WITH rows0 AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('x' || lang, '') AS t, {_leaf('text')} AS leaf,
    CASE WHEN {crc32('doc_id')} % 3 = 0 THEN {_leaf(lowered('text'))} END AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows0),
leaves AS (SELECT t, pos, leaf AS h FROM placed),
{_levels('a', 'leaves', _DEEP)},
subs AS (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS pos, h, t AS lang_key FROM a{_DEEP}),
{_levels('b', 'subs', _WIDE)},
begun AS (SELECT id, t, pos, coalesce(changed, leaf) AS acc, '' AS proof FROM placed),
{_folds('f', 'a', 'begun', _DEEP)},
again AS (SELECT f.id, '' AS t, s.pos, f.acc, f.proof FROM f{_DEEP} f JOIN subs s ON s.lang_key = f.t),
{_folds('g', 'b', 'again', _WIDE)}
SELECT p.doc_id, p.leaf, s.h AS subroot, b.h AS root, sha256(g.proof) AS proof_sha256, g.acc AS folded_root,
  g.acc = b.h AS verified
FROM placed p JOIN g{_WIDE} g USING (id) JOIN subs s ON s.lang_key = p.t CROSS JOIN b{_WIDE} b"""


# --- conversation trie ----------------------------------------------------------------

TRIE = f"""WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32('conv_id')} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)),
parts AS (
  SELECT c.conv_id, 0 AS part, o.p, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.p <= c.h
  UNION ALL SELECT c.conv_id, 1, o.p, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.p > c.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS depth, role, text FROM parts),
named AS (SELECT conv_id, depth, length(text) AS n_chars,
    sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM turns),
prefixes AS (SELECT * FROM named UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lasts AS (SELECT conv_id, max(depth) AS total FROM prefixes GROUP BY conv_id),
ends AS (SELECT name, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM prefixes JOIN lasts USING (conv_id) WHERE depth = total GROUP BY name),
nodes AS (SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars
  FROM prefixes GROUP BY name, depth),
parents AS (SELECT n.name, u.name AS parent FROM nodes n
  JOIN prefixes u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1),
children AS (SELECT parent AS name, count(*) AS n_children FROM parents GROUP BY parent),
below AS (SELECT a.name, count(*) FILTER (k.n_children IS NULL) AS n_leaves,
    sum((m.n_convs - 1) * m.n_chars) AS saved
  FROM nodes m JOIN prefixes a ON a.conv_id = m.conv_id AND a.depth <= m.depth
  LEFT JOIN children k ON k.name = m.name GROUP BY a.name)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs,
  coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM nodes n JOIN below b USING (name) LEFT JOIN children k USING (name) LEFT JOIN ends e USING (name)
LEFT JOIN parents p USING (name) LEFT JOIN nodes u ON u.name = p.parent"""

# --- license scan -----------------------------------------------------------------------


def licenses(phrases, templates, least: float) -> str:
    """Every window of every size class against every template, by shared words."""

    def words(text: str) -> str:
        return f"regexp_extract_all({lowered(text)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    notices = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(templates))
    named = ", ".join(f"('{phrase}', '{label}')" for phrase, label in phrases)
    return f"""WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
places AS (SELECT id, label, i - 1 AS start FROM
  (SELECT id, w, unnest(generate_series(1, len(w))) AS i FROM docs),
  (SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {named}) AS v(phrase, label))
  WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (SELECT id, count(*) AS n, min(start) AS f, max(start) AS l,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY id),
notices AS (SELECT t, label, {words('notice')} AS w FROM (VALUES {notices}) AS v(t, label, notice)),
sized AS (SELECT t, label, w, (2 ** ceil(log2(len(w))))::BIGINT AS s, len(list_distinct(w)) AS n FROM notices),
asked AS (SELECT DISTINCT t, label, s, n, unnest(w) AS word FROM sized),
said AS (SELECT id, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS nth FROM docs WHERE len(w) > 0),
hits AS (SELECT id, t, label, n, word, nth // s AS block FROM said JOIN asked USING (word)
  UNION ALL SELECT id, t, label, n, word, nth // s - 1 FROM said JOIN asked USING (word) WHERE nth >= s),
near AS (SELECT id, label, count(DISTINCT word) / n::DOUBLE AS share FROM hits GROUP BY id, t, label, n, block
  HAVING count(DISTINCT word) >= ceil(n * {least}::DOUBLE - 1e-9::DOUBLE)),
more AS (SELECT id, label, share FROM near UNION ALL SELECT id, label, 1.0::DOUBLE FROM places),
every AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM more GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.f::BIGINT AS first_word,
  b.l::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
  coalesce(e.score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN base b USING (id) LEFT JOIN every e USING (id)"""
