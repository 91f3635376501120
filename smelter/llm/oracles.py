"""SQL for the queries that SQL can express."""

from __future__ import annotations

_PLAIN = "coalesce(text, '')"


def _escaped(column: str) -> str:
    """Backslashes doubled, one after the first character of every mark."""
    out = f"replace({column}, '\\', '\\\\')"
    for mark in ("<s>", "</s>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


_OP1 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, {_PLAIN} AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                                  (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
sized AS (
  SELECT *, role = 'assistant' AS reply,
    length('<s>[INST] ' || {_escaped('role')} || ' [/INST] ' || {_escaped('text')} || '</s>') AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns),
upto AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM sized)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(CASE WHEN reply THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN reply THEN text END, '' ORDER BY place), '')) AS loss_sha256,
  sum(CASE WHEN reply OR place = n THEN prefix ELSE 0 END)::BIGINT AS formatted_chars
FROM upto GROUP BY conv_id"""

def _rest(url: str) -> str:
    return f"regexp_replace(regexp_replace({url}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '', 's')"


def _host(url: str) -> str:
    bare = f"regexp_replace(split_part({_rest(url)}, '/', 1), '^.*@', '', 's')"
    return f"lower(regexp_replace(regexp_replace({bare}, ':[0-9]*$', ''), '\\.+$', ''))"


def _segments(url: str) -> str:
    return f"list_filter(string_split({_rest(url)}, '/')[2:], lambda s: s <> '')"


_OP2 = f"""
WITH captures AS (
  SELECT page_id, page_id % 365 AS day, {_host('url')} AS host, {_segments('url')} AS segments,
    '/' || array_to_string(string_split({_rest('url')}, '/')[2:], '/') AS path
  FROM pages),
spelled AS (
  SELECT CASE page_id % 4 WHEN 1 THEN upper(host) || '.' WHEN 2 THEN 'http://u@' || host || ':80/' ELSE host END AS entry,
    day, 'host' AS label, page_id % 3 = 0 AS listed FROM captures
  UNION ALL
  SELECT CASE WHEN page_id % 2 = 0 THEN host || '/' || string_split(path, '/')[2]
    ELSE 'HTTPS://' || host || '//' || path[2:] || '//?q#f' END, day + 7, 'path', page_id % 3 <> 0
  FROM captures WHERE page_id % 5 = 0
  UNION ALL
  SELECT regexp_replace(host, '^[^.]*\\.', ''), day + 100, 'domain', page_id % 2 = 0 FROM captures WHERE page_id % 7 = 0),
entries AS (
  SELECT CASE WHEN {_host('entry')} <> '' THEN array_to_string(list_concat([{_host('entry')}], {_segments('entry')}), '/') END AS pattern,
    day, label, listed FROM spelled),
daily AS (
  SELECT pattern, label, day, bool_or(listed) AS listed FROM entries
  WHERE pattern IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
held AS (
  SELECT pattern, label, listed, day AS since, lead(day) OVER (PARTITION BY pattern, label ORDER BY day) AS until FROM daily),
asked AS (
  SELECT DISTINCT page_id, day, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1),
                   lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(segments) + 1), lambda k: host || '/' || array_to_string(segments[1:k], '/')))) AS pattern
  FROM captures WHERE host <> ''),
found AS (
  SELECT DISTINCT a.page_id, a.pattern, h.label FROM asked a JOIN held h
  ON a.pattern = h.pattern AND h.listed AND a.day >= h.since AND (h.until IS NULL OR a.day < h.until)),
listed AS (SELECT page_id, count(*) AS n_active, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY page_id)
SELECT c.page_id, coalesce(n_active, 0) AS n_active, coalesce(labels, '') AS labels, l.page_id IS NULL AS passes
FROM captures c LEFT JOIN listed l USING (page_id)"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP8 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {_TOKENS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM sized)),
docs AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n),
phrases AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM places),
met AS (SELECT p.doc_id, p.n, p.s, v.item_id FROM phrases p JOIN windows v ON p.n = v.n AND p.phrase = v.phrase),
hit AS (SELECT doc_id, count(DISTINCT word_at) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS word_at FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM met GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

# The reversed CRC-32 table for four bits at a time: fixed by the polynomial 0xEDB88320.
_NIBBLES = (0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
            0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C)


def _feistel(x: str) -> list[str]:
    """CTEs that walk ``x`` until it is back in the table, as a recursion over what is outside."""
    from smelter.llm.sharding import KEY, PRIME

    left, right = f"({x} // side)", f"({x} % side)"
    steps, columns = [], f"SELECT *, {left} AS l0, {right} AS r0"
    steps.append(columns)
    for i, (m, a) in enumerate(KEY):
        t = f"((r{i} * {m} + {a}) % {PRIME})"
        steps.append(f"SELECT *, r{i} AS l{i + 1}, (l{i} + ({t} * {t} + {t} * {m}) % {PRIME} % side) % side AS r{i + 1}")
    return steps


def _nested(source: str) -> str:
    query = source
    for step in _feistel("x"):
        query = f"{step} FROM ({query})"
    return query


_OP9 = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, hex(encode({_PLAIN})) AS h, strlen({_PLAIN}) + 1 AS size, text FROM documents),
summed AS (
  SELECT doc_id, size::BIGINT AS size, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, 2 * size - 1), lambda i: (strpos('0123456789ABCDEF', h[i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END]) - 1)::BIGINT)),
    lambda c, v: xor(c >> 4, [{', '.join(f'{n}::BIGINT' for n in _NIBBLES)}][(xor(c, v) & 15) + 1])))::BIGINT AS text_crc32
  FROM sized),
numbered AS (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size, text) - 1 AS number,
    count(*) OVER () AS n FROM summed),
sided AS (SELECT *, CASE WHEN n <= 1 THEN 1 ELSE floor(sqrt(n - 1))::BIGINT + 1 END AS side FROM numbered),
walk AS (
  SELECT number, n, side, l6 * side + r6 AS x, 1 AS k FROM ({_nested('SELECT number, n, side, number AS x FROM sided')})
  UNION ALL
  SELECT number, n, side, l6 * side + r6 AS x, k + 1 FROM ({_nested('SELECT number, n, side, x, k FROM walk WHERE x >= n')}))
SELECT s.doc_id, s.size, s.text_crc32, 'rows' AS law, (w.x % 16)::INTEGER AS shard, (w.x // 16)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard
FROM sided s JOIN walk w ON s.number = w.number AND w.x < w.n"""

_SHINGLES = "regexp_extract_all(" + _LOW + ", '[^\\x20\\x09-\\x0D]+')"

_OP10 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_SHINGLES} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
rated AS (SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS often FROM tokens),
ranked AS (SELECT doc_id, t, often, row_number() OVER (PARTITION BY doc_id ORDER BY often, t) AS place FROM rated),
rare AS (SELECT doc_id, t FROM ranked JOIN sizes USING (doc_id) WHERE often > 1 AND place <= n - (n * 85 + 99) // 100 + 1),
maybe AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.t = b.t AND a.doc_id < b.doc_id),
common AS (
  SELECT a, b, count(*) AS c FROM maybe JOIN tokens x ON x.doc_id = a JOIN tokens y ON y.doc_id = b AND y.t = x.t GROUP BY a, b),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.seen)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, min(r.seen) AS component_id
FROM sizes s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.n"""

_OP11 = """
WITH vectors AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, x.n, x.vec_id, a.label = x.label AS same,
    list_dot_product(a.q, x.q)::BIGINT AS score
  FROM vectors a JOIN vectors x ON a.vec_id % 50 = 0 AND a.n <> x.n),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, n) <= 5),
windowed AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, x.vec_id AS negative_id, p.score AS positive_score, x.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY x.score DESC, x.vec_id, x.n)::INTEGER AS rank
  FROM positives p JOIN scored x ON p.anchor = x.anchor AND NOT x.same
    AND 50 * p.score <= 100 * x.score AND 100 * x.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM windowed WHERE rank <= 3"""

ORACLES = {
    "op1_prefix_targets": _OP1, "op2_url_lists": _OP2, "op8_decontaminate": _OP8, "op9_feistel": _OP9,
    "op10_parity_join": _OP10, "op11_anchor_tree": _OP11,
}
