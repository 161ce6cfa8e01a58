"""SQL for the corpus queries that SQL can express, over the same tables."""

from __future__ import annotations

from pixelsieve.llm import licenses

# Words of the license scan and of the join, after lower-casing A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LICENSE_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _components(links: str, nodes: str) -> str:
    """CTEs that give (id, component) of ``nodes`` by undirected ``links`` (a, b)."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
    reached AS (SELECT id, id AS other FROM {nodes} UNION SELECT r.id, e.b FROM reached r JOIN both_ways e ON e.a = r.other),
    grouped AS (SELECT id, min(other) AS component FROM reached GROUP BY id)"""


def license_scan(k: int = licenses.WORDS, neighbour: int = licenses.NEIGHBOUR, share: float = licenses.SHARE, least: int = licenses.LEAST_GRAMS) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    templates = ", ".join(f"({quote(label)}, {quote(text)})" for label, text in licenses.TEMPLATES.items())
    phrases = ", ".join(f"({quote(label)}, {quote(' '.join(p.split()))}, {len(p.split())})" for p, label in licenses.PHRASES.items())
    lower = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = lambda n: f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"
    return f"""WITH words AS (SELECT doc_id, {_LICENSE_WORDS.format(_LOWER)} AS w FROM documents),
    phrases AS (SELECT * FROM (VALUES {phrases}) AS p(label, phrase, n)),
    places AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ') = phrase)) - 1 AS place FROM words, phrases WHERE contains(array_to_string(w, ' '), phrase)),
    base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
    templates AS (SELECT label, {_LICENSE_WORDS.format(lower)} AS w FROM (VALUES {templates}) AS t(label, t)),
    positions AS (SELECT label, len(w) - {k} + 1 AS size, unnest({grams(k)}) AS gram, unnest(range(0, len(w) - {k} + 1)) AS place FROM templates),
    rolling AS (SELECT doc_id, unnest({grams(k)}) AS gram, unnest(range(0, len(w) - {k} + 1)) AS position FROM words WHERE len(w) >= {k}),
    hits AS (SELECT doc_id, label, size, position, place, position - place AS diagonal FROM rolling JOIN positions USING (gram)),
    diagonals AS (SELECT doc_id, label, size, diagonal, list(DISTINCT place) AS covered, min(position) AS first, max(position) AS last FROM hits GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, label ORDER BY diagonal) <= {neighbour} THEN 0 ELSE 1 END AS new FROM diagonals),
    bands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, label ORDER BY diagonal) AS band FROM marked),
    spans AS (SELECT doc_id, label, size, len(list_distinct(flatten(list(covered)))) AS n_covered, CAST(n_covered AS DOUBLE) / size AS share, min(first) AS first, max(last) + {k} - 1 AS last FROM bands GROUP BY doc_id, label, size, band),
    found AS (SELECT doc_id, list(label) AS labels, max(share) AS share, to_json(list({{'label': label, 'first': first, 'last': last, 'share': share}} ORDER BY label, first, last, share)) AS spans FROM spans WHERE share >= {share} AND n_covered >= least(size, {least}) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(coalesce(base_labels, ''), ','), coalesce(f.labels, [])), lambda x: x <> ''))), ',') AS labels,
    greatest(coalesce(f.share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score, CAST(f.spans AS VARCHAR) AS spans
    FROM words d LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)"""


def embedding_neardup(cosine: float) -> str:
    dot = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
    return f"""WITH RECURSIVE vectors AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    normed AS (SELECT id, label, v, sqrt({dot.format('v', 'v')}) AS norm FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    links AS (SELECT p.id AS a, q.id AS b FROM normed p JOIN normed q ON p.label = q.label AND p.id < q.id WHERE p.norm > 0 AND q.norm > 0 AND {dot.format('p.v', 'q.v')} / (p.norm * q.norm) >= {cosine}),
    {_components('links', 'vectors')}
    SELECT id AS vec_id, (SELECT count(*) FROM both_ways WHERE a = id) AS n_links, component AS component_id, id = component AS kept FROM grouped"""


def decontamination(k: int = 5, percent: int = 80) -> str:
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pM\pN]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"
    return f"""WITH items AS (SELECT item_id, w, least({k}, len(w)) AS k FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
    entries AS (SELECT item_id, k, len(gs) AS size, unnest(gs) AS g FROM (SELECT item_id, k, {grams} AS gs FROM items)),
    texts AS (SELECT doc_id, {words} AS w FROM documents),
    docs AS (SELECT doc_id, k, unnest({grams}) AS g FROM texts, (SELECT DISTINCT k FROM items) WHERE len(w) >= k),
    pairs AS (SELECT doc_id, item_id, CAST(size AS INTEGER) AS item_shingles, CAST(count(*) AS INTEGER) AS shared FROM docs JOIN entries USING (k, g) GROUP BY doc_id, item_id, size)
    SELECT doc_id, item_id, item_shingles, shared, CAST(shared AS DOUBLE) / CAST(item_shingles AS DOUBLE) AS containment FROM pairs WHERE shared * 100 >= item_shingles * {percent}"""


def tool_call_linking() -> str:
    """Reads conversations as ``chat.turns_as_tool_messages`` says; links, orders and checks them by plain joins and recursion."""
    quote = "CAST(to_json({}) AS VARCHAR)"
    return f"""WITH RECURSIVE turns AS (SELECT conv_id, turn, role, text, coalesce(text, '') AS t, split_part(coalesce(text, ''), ' ', 1) AS w,
        contains(coalesce(text, ''), chr(10)) AS lines, contains(coalesce(text, ''), ',') AS comma FROM conversations),
    marked AS (SELECT *, w <> '' AND contains(substr(t, length(w) + 1), w) AS again FROM turns),
    asked AS (SELECT *, conv_id || ':' || turn AS id FROM marked WHERE role = 'user'),
    calls AS (SELECT conv_id, turn, id AS call_id, 'reply' AS name, CASE WHEN length(t) < 60 THEN 'null,"arguments_text":' || coalesce({quote.format('text')}, 'null')
            WHEN lines THEN '{{"length":"' || length(t) || '","prompt":' || {quote.format('t')} || '}}' WHEN NOT comma THEN '{{"prompt":' || {quote.format('t')} || ',"tone":"plain"}}'
            ELSE '{{"length":' || length(t) || ',"prompt":' || {quote.format('t')} || '}}' END AS arguments,
            CASE WHEN length(t) < 60 THEN ['arguments are no object'] WHEN lines THEN ['length is no integer'] WHEN NOT comma THEN ['missing length', 'unknown tone'] ELSE CAST([] AS VARCHAR[]) END AS errors FROM asked
        UNION ALL SELECT conv_id, turn, id || ':check', CASE WHEN lines THEN 'audit' ELSE 'check' END, '{{"of":"' || id || '"}}', CASE WHEN lines THEN ['unknown tool'] ELSE CAST([] AS VARCHAR[]) END FROM asked),
    cited AS (SELECT conv_id, id AS a, conv_id || ':' || (CASE WHEN comma THEN turn - 2 ELSE turn + 2 END) AS b FROM asked
        UNION SELECT conv_id, id, id || ':check' FROM asked WHERE again UNION SELECT conv_id, id || ':check', id FROM asked),
    edges AS (SELECT e.* FROM cited e SEMI JOIN calls c ON c.conv_id = e.conv_id AND c.call_id = e.b),
    reached AS (SELECT conv_id, call_id AS a, call_id AS b FROM calls UNION SELECT r.conv_id, r.a, e.b FROM reached r JOIN edges e ON e.conv_id = r.conv_id AND e.a = r.b),
    ordered AS (SELECT r.conv_id, r.a AS call_id, max(c.turn) AS order_turn FROM reached r JOIN calls c ON c.conv_id = r.conv_id AND c.call_id = r.b GROUP BY ALL),
    inner_edges AS (SELECT e.* FROM edges e JOIN ordered p ON p.conv_id = e.conv_id AND p.call_id = e.a JOIN ordered q ON q.conv_id = e.conv_id AND q.call_id = e.b AND q.order_turn = p.order_turn),
    walks AS (SELECT conv_id, call_id AS a, call_id AS b, 0 AS n FROM calls UNION SELECT w.conv_id, w.a, e.b, w.n + 1 FROM walks w JOIN inner_edges e ON e.conv_id = w.conv_id AND e.a = w.b WHERE w.n < 20),
    depths AS (SELECT conv_id, a AS call_id, max(n) AS depth, max(n) = 20 AS cyclic FROM walks GROUP BY ALL),
    placed AS (SELECT c.*, order_turn, CASE WHEN cyclic THEN 0 ELSE depth END AS depth, cyclic FROM calls c JOIN ordered USING (conv_id, call_id) JOIN depths USING (conv_id, call_id)),
    results AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, t AS content FROM marked WHERE role = 'assistant'
        UNION ALL SELECT conv_id, turn, conv_id || ':' || (turn - 1) || ':check', 'ok' FROM marked WHERE role = 'assistant' AND lines
        UNION ALL SELECT conv_id, turn, conv_id || ':' || (turn - 3), 'again' FROM marked WHERE role = 'assistant' AND again),
    answered AS (SELECT conv_id, call_id, min(r.turn) AS seen FROM results r JOIN calls c USING (conv_id, call_id) WHERE r.turn > c.turn GROUP BY ALL)
    SELECT p.conv_id, p.turn, 'call' AS kind, p.call_id, CASE WHEN cyclic THEN 'cyclic' WHEN seen IS NULL THEN 'unanswered' ELSE 'linked' END AS status, order_turn, CAST(depth AS INTEGER) AS depth, CAST(len(errors) AS BIGINT) AS n_errors,
        '{{"arguments":' || arguments || ',"errors":' || CAST(to_json(errors) AS VARCHAR) || ',"id":"' || p.call_id || '","name":"' || name || '","type":"call"}}' AS json
    FROM placed p LEFT JOIN answered USING (conv_id, call_id)
    UNION ALL SELECT r.conv_id, r.turn, 'result', r.call_id, CASE WHEN p.turn IS NULL OR r.turn <= p.turn THEN 'orphan' WHEN r.turn = seen THEN 'linked' ELSE 'repeated' END, greatest(r.turn, coalesce(p.order_turn, r.turn)),
        CAST(CASE WHEN p.turn IS NULL OR p.cyclic THEN 0 ELSE p.depth + 1 END AS INTEGER), 0, '{{"content":' || {quote.format('content')} || ',"id":"' || r.call_id || '","type":"result"}}'
    FROM results r LEFT JOIN placed p USING (conv_id, call_id) LEFT JOIN answered USING (conv_id, call_id)
    UNION ALL SELECT conv_id, turn, 'message', NULL, 'message', turn, 0, 0, '{{"content":' || coalesce({quote.format('text')}, 'null') || ',"role":' || coalesce({quote.format('role')}, 'null') || ',"type":"message"}}'
    FROM turns WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""


def sharding(shards: int, rows_per_bin: int, most_bins: int, piece: int, multiplier: int) -> str:
    def unrolled(n: int) -> str:
        """The states of all steps as nested CTE columns: lists of structs fold badly."""
        ctes, before = [], "keyed"
        for i in range(n):
            name = f"s{n}_{i}"
            ctes.append(f"""{name} AS (SELECT * EXCLUDE (k, b, j, nk), CASE WHEN j < {n} THEN nk ELSE k END AS k, CASE WHEN j < {n} THEN j ELSE b END AS b,
                CASE WHEN j < {n} THEN CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST((nk // 8589934592) + 1 AS DOUBLE))) AS BIGINT) ELSE j END AS j
                FROM (SELECT *, (k * {multiplier} + 1) % 18446744073709551616::HUGEINT AS nk FROM {before}))""")
            before = name
        return ", ".join(ctes)

    crc = "list_transform(range(0, 256), lambda n: {})"
    inner = "CAST(n AS BIGINT)"
    for _ in range(8):
        inner = f"list_transform([{inner}], lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)[1]"
    nibbles = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: (strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1)"
    return f"""WITH crc AS (SELECT {crc.format(inner)} AS t),
    keyed AS (SELECT doc_id, coalesce(text, '') AS text, (CAST(coalesce(doc_id, 0) AS HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS key, (CAST(coalesce(doc_id, 0) AS HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM documents),
    {unrolled(shards)}, {unrolled(shards + 1)},
    placed AS (SELECT p.doc_id, p.text, p.key, CAST(p.b AS INTEGER) AS shard, CAST(g.b AS INTEGER) AS grown_shard
        FROM s{shards}_{shards - 1} p JOIN s{shards + 1}_{shards} g USING (doc_id)),
    summed AS (SELECT doc_id, key, shard, grown_shard, CAST(octet_length(encode(text)) AS BIGINT) + 1 AS size,
        xor(list_reduce({nibbles}, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM placed, crc),
    cut AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {piece} AS piece FROM summed),
    binned AS (SELECT *, ((xor(xor(key, CAST(text_crc32 AS HUGEINT)), CAST(piece AS HUGEINT) * 4294967296) * {multiplier} + 1) % 18446744073709551616::HUGEINT // 4294967296)
        % (SELECT least({most_bins}, 1 + count(*) // {rows_per_bin}) FROM documents) AS bin FROM cut)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bin, doc_id, size, text_crc32, piece) - 1 AS slot, grown_shard FROM binned"""


def ngram_jaccard(k: int, num: int, den: int) -> str:
    words = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
    grams = f"CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""WITH RECURSIVE sets AS (SELECT doc_id AS id, {grams} AS gs FROM (SELECT doc_id, {words} AS w FROM documents)),
    members AS (SELECT id, len(gs) AS n, unnest(gs) AS g FROM sets),
    shared AS (SELECT p.id AS a, q.id AS b, p.n + q.n AS total, count(*) AS common FROM members p JOIN members q ON p.g = q.g AND p.id < q.id GROUP BY ALL),
    links AS (SELECT a, b FROM shared WHERE {den} * common >= {num} * (total - common)),
    {_components('links', 'sets')}
    SELECT id AS doc_id, CAST(len(gs) AS BIGINT) AS n_shingles, component AS component_id FROM sets JOIN grouped USING (id)"""


def warc() -> str:
    bits = "list_transform(range(0, 8), lambda g: CAST(('0x' || h[g * 5 + 1:g * 5 + 5]) AS BIGINT))"
    digest = f"array_to_string(list_transform({bits}, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '')"
    return f"""WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    lasts AS (SELECT payload, max(page_id) AS last FROM payloads GROUP BY payload),
    hashed AS (SELECT page_id, payload, sha1(payload) AS h, last FROM payloads JOIN lasts USING (payload))
    SELECT p.page_id, coalesce(url, 'about:blank') AS url, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, {digest} AS payload_digest,
    CASE WHEN h.page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN h.page_id < last THEN last END AS refers_to FROM hashed h JOIN pages p USING (page_id)"""
