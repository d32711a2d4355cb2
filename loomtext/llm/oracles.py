"""The operators' queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from loomtext.llm import decontaminate, pii, sharding, simhash, urls

WARC = """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), q AS (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM q
"""

#: Every 400-byte string is counted, which is for small tables.
REPEATS = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    w AS (SELECT r, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400),
    h AS (SELECT w.r, i, md5_number(array_slice(b, i, i + 399)) AS h FROM w JOIN d ON w.r = d.r),
    s AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
    e AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM e),
    m AS (SELECT r, run, min(i) AS first, max(i) + 399 AS last FROM g GROUP BY r, run),
    k AS (SELECT m.r, first AS place, hex(array_slice(b, coalesce(lag(last) OVER (PARTITION BY m.r ORDER BY first), 0) + 1, first - 1)) AS piece, last - first + 1 AS gone FROM m JOIN d ON m.r = d.r
          UNION ALL SELECT d.r, 1000000000 AS place, hex(array_slice(b, coalesce(l.last, 0) + 1, n)) AS piece, NULL AS gone FROM d LEFT JOIN (SELECT r, max(last) AS last FROM m GROUP BY r) l ON l.r = d.r)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(sum(gone), 0)::BIGINT AS n_removed, count(gone) AS n_spans, sha256(unhex(string_agg(piece, '' ORDER BY place))) AS kept_sha256
    FROM k JOIN d ON k.r = d.r GROUP BY d.r, doc_id, n
"""


def _rate(bad: str, n: str, towards: str) -> str:
    return f"(({bad} + {urls.SMOOTHING} * {towards}) / ({n} + {urls.SMOOTHING}))"


def url_templates() -> str:
    """The tree of templates, a level at a time."""
    rules = [*reversed(sorted(urls.RULES, key=lambda r: len(r[1] + r[2])))]
    fits = [f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{prefix}')" for _, name, prefix in rules]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    plain = lambda c: f"regexp_replace({c}, '([*\\\\])', '\\\\\\1', 'g')"
    p = _rate("n.bad", "(n.good + n.bad)", "0.5")
    seen, other = "(s.good + s.bad)", "(n.good + n.bad - s.good - s.bad)"
    gap = f"({_rate('s.bad', seen, 'p')} - {_rate('(n.bad - s.bad)', other, 'p')})"
    z = f"(abs({gap}) / sqrt(p * (1 - p) * (1 / ({seen} + {urls.SMOOTHING}) + 1 / ({other} + {urls.SMOOTHING}))))"
    levels = []
    for i in range(urls.DEPTH):
        levels.append(f"""
    a{i} AS MATERIALIZED (SELECT *, parts[{i + 1}] AS part, regexp_replace(parts[{i + 1}], '[0-9]+', '#', 'g') AS shape FROM r{i}),
    s{i} AS MATERIALIZED (SELECT host, template, shape, count(DISTINCT part) AS v, sum(good) AS good, sum(bad) AS bad FROM a{i} WHERE part IS NOT NULL GROUP BY ALL),
    n{i} AS MATERIALIZED (SELECT *, {p} AS p FROM (SELECT host, template, count(*) AS branches, sum(good) AS good, sum(bad) AS bad FROM s{i} GROUP BY ALL) n),
    m{i} AS MATERIALIZED (SELECT s.host, s.template, s.shape, s.v >= {urls.VARIED} AS varied, branches >= {urls.MANY} AND {z} < {urls.Z} AS alike FROM s{i} s JOIN n{i} n USING (host, template)),
    r{i + 1} AS MATERIALIZED (
        SELECT a.host, a.path, a.n, a.good, a.bad, a.parts,
               CASE WHEN part IS NULL THEN a.template ELSE a.template || '/' || CASE WHEN alike THEN '*' WHEN varied THEN {plain('a.shape')} ELSE {plain('part')} END END AS template
        FROM a{i} a LEFT JOIN m{i} m ON a.host = m.host AND a.template = m.template AND a.shape = m.shape),""")
    placed = f"r{urls.DEPTH}"
    base = f"(SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(good), 0) + coalesce(sum(bad), 0) + 2) FROM {placed})"
    host = _rate("h.bad", "(h.good + h.bad)", "b.base")
    return f"""
    WITH t AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS MATERIALIZED (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
    l AS (SELECT doc_id, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM (SELECT doc_id, quality = 1 AND toxic = 0 AS good FROM labels) GROUP BY doc_id),
    c AS (SELECT host, path, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM u LEFT JOIN l ON page_id = doc_id GROUP BY host, path),
    x AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS all_parts FROM c),
    r0 AS MATERIALIZED (
        SELECT host, path, n, good, bad, '' AS template,
               CASE WHEN path = '' THEN [] WHEN len(all_parts) > {urls.DEPTH} THEN list_append(all_parts[1:{urls.DEPTH - 1}], array_to_string(all_parts[{urls.DEPTH}:], '/')) ELSE all_parts END AS parts FROM x),{"".join(levels)}
    h AS (SELECT host, sum(good) AS good, sum(bad) AS bad FROM {placed} GROUP BY host),
    j AS (SELECT e.host, e.template, round(1 - {_rate('e.bad', '(e.good + e.bad)', host)}, 6) AS purity
          FROM (SELECT host, template, sum(good) AS good, sum(bad) AS bad FROM {placed} GROUP BY ALL) e JOIN h USING (host), (SELECT {base} AS base) b)
    SELECT page_id, host, path, {case([name + prefix for _, name, prefix in rules])} AS rule,
           coalesce({case([verdict for verdict, _, _ in rules])}, CASE WHEN purity < {urls.PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
    FROM u JOIN (SELECT host, path, template FROM {placed}) USING (host, path) JOIN j USING (host, template)
    """


def disclosure() -> str:
    """Entities, disclosing terms and where they stand."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    word = r"[\p{L}\p{N}]+"
    start = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"

    def located(kind: str, pattern: str, source: str) -> str:
        return f"""SELECT r, '{kind}' AS kind, ({start})::BIGINT AS start, ({start} + length(m[i]))::BIGINT AS stop, m[i] AS value
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM {source}))"""

    valid = """CASE kind WHEN 'email' THEN true
            WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS BIGINT), 0) > 255)) = 0
            WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
                CASE WHEN (length(digits) - k) % 2 = 0 THEN digits[k]::INT WHEN digits[k]::INT > 4 THEN digits[k]::INT * 2 - 9 ELSE digits[k]::INT * 2 END)) % 10 = 0
            ELSE length(digits) BETWEEN 9 AND 15 END"""
    number = {k: i for i, k in enumerate([*patterns, "term"])}
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in number.items()) + " END"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in patterns)
    joined = lambda which: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {order}, start) FILTER ({which}), '')"
    general = lambda c: f"regexp_replace({c}, '[0-9]', '#', 'g')"
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    f AS MATERIALIZED (SELECT * FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM ({" UNION ALL ".join(located(k, p, "d") for k, p in patterns.items())})) WHERE {valid}),
    e AS MATERIALIZED (SELECT entity, count(DISTINCT r) AS n_entity FROM (SELECT r, lower(value) AS entity FROM f) GROUP BY entity),
    c AS (SELECT f.r, lower(value) AS entity, unnest(list_transform(list_concat(list_reverse(list_reverse(regexp_extract_all(substr(t, 1, start), '{word}'))[1:{pii.NEAR}]),
            regexp_extract_all(substr(t, stop + 1), '{word}')[1:{pii.NEAR}]), lambda w: lower(w))) AS w FROM f JOIN d ON f.r = d.r),
    b AS MATERIALIZED (SELECT term, entity, count(DISTINCT r) AS n_both FROM (SELECT r, entity, unnest([w, {general('w')}]) AS term FROM c WHERE length(w) >= {pii.TERM_LENGTH}) GROUP BY term, entity),
    w AS MATERIALIZED (SELECT r, lower(v) AS w FROM (SELECT r, unnest(list_distinct(regexp_extract_all(t, '{word}'))) AS v FROM d)),
    n AS (SELECT term, count(DISTINCT r) AS n_term FROM (SELECT r, unnest([w, {general('w')}]) AS term FROM w) GROUP BY term),
    p AS (SELECT term, n_term, n_both, greatest((SELECT count(*) FROM d), n_entity + 1) / n_entity AS whole FROM b JOIN e USING (entity) JOIN n USING (term) WHERE n_both >= {pii.SUPPORT} AND n_entity >= {pii.SUPPORT}),
    k AS MATERIALIZED (SELECT DISTINCT term FROM p WHERE log2(whole * n_both / greatest(n_term, n_both)) / log2(whole) >= {pii.DISCLOSURE} AND NOT contains(term, '#')),
    h AS MATERIALIZED (SELECT r, t FROM d WHERE r IN (SELECT r FROM w JOIN k ON w.w = k.term)),
    s AS (SELECT r, kind, start, stop FROM f UNION ALL SELECT r, kind, start, stop FROM ({located("term", word, "h")}) WHERE lower(value) IN (SELECT term FROM k))
    SELECT doc_id, {counts}, sha256({joined("kind <> 'term'")}) AS base_sha256, {joined("kind IS NOT NULL")} AS spans
    FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r, doc_id
    """


class _Xx64:
    """XXH64 in SQL, on UHUGEINT values below 2 to the 64; five fixed primes."""

    P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    WHOLE = "18446744073709551616::UHUGEINT"

    def __init__(self):
        self.names = iter(range(1 << 20))

    def bound(self, value: str, body) -> str:
        """body of a value that is used twice."""
        name = f"v{next(self.names)}"
        return f"list_transform([{value}], lambda {name}: {body(name)})[1]"

    def big(self, n: int) -> str:
        return f"{n % (1 << 64)}::UHUGEINT"

    def add(self, a: str, b: str) -> str:
        return f"(({a} + {b}) % {self.WHOLE})"

    def times(self, a: str, n: int) -> str:
        return f"(({a} * {self.big(n)}) % {self.WHOLE})"

    def turn(self, x: str, k: int) -> str:
        return self.bound(x, lambda v: f"(({v} * {1 << k}::UHUGEINT) % {self.WHOLE} + {v} // {1 << (64 - k)}::UHUGEINT)")

    def shift(self, x: str, k: int) -> str:
        return self.bound(x, lambda v: f"xor({v}, {v} // {1 << k}::UHUGEINT)")

    def step(self, acc: str, lane: str) -> str:
        return self.times(self.turn(self.add(acc, self.times(lane, self.P2)), 31), self.P1)

    def merged(self, h: str, lane: str) -> str:
        return self.add(self.times(f"xor({h}, {self.step(self.big(0), lane)})", self.P1), self.big(self.P4))

    def eight(self, h: str, lane: str) -> str:
        return self.add(self.times(self.turn(f"xor({h}, {self.step(self.big(0), lane)})", 27), self.P1), self.big(self.P4))

    def four(self, h: str, lane: str) -> str:
        return self.add(self.times(self.turn(f"xor({h}, {self.times(lane, self.P1)})", 23), self.P2), self.big(self.P3))

    def one(self, h: str, lane: str) -> str:
        return self.times(self.turn(f"xor({h}, {self.times(lane, self.P5)})", 11), self.P1)

    def last(self, h: str) -> str:
        return self.shift(self.times(self.shift(self.times(self.shift(h, 33), self.P2), 29), self.P3), 32)


def jump_shards() -> str:
    """Keys hashed and walked by jumps, texts summed up byte by byte; slots as of a table that has one bucket a shard (under 1.6 million rows)."""
    x = _Xx64()
    key = x.last(x.eight(x.big(simhash.SEED + x.P5 + 8), "k"))
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda acc, y: xor(crcs[((xor(acc, y) & 255) + 1)::BIGINT], acc >> 8))"
    walk = f"""SELECT id, n, (key * {sharding.JUMP_MULTIPLIER}::UHUGEINT + 1) % {x.WHOLE} AS key, j AS b,
               floor((j + 1) * (2147483648::DOUBLE / (((key * {sharding.JUMP_MULTIPLIER}::UHUGEINT + 1) % {x.WHOLE} // 8589934592::UHUGEINT)::DOUBLE + 1)))::BIGINT AS j"""
    return f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    i AS (SELECT DISTINCT doc_id AS id, ((doc_id::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::UHUGEINT AS k FROM d WHERE doc_id IS NOT NULL),
    h AS (SELECT id, {key} AS key FROM i UNION ALL SELECT NULL, {simhash.SEED}::UHUGEINT),
    w AS (SELECT id, n, key, -1::BIGINT AS b, 0::BIGINT AS j FROM h, (VALUES ({sharding.SHARDS}), ({sharding.SHARDS + 1})) AS s(n)
          UNION ALL {walk} FROM w WHERE j < n),
    s AS MATERIALIZED (SELECT id, n, b FROM w WHERE j >= n),
    c AS (SELECT doc_id, n + {sharding.ROW_OVERHEAD} AS size, xor({crc}, 4294967295::UBIGINT)::BIGINT AS text_crc32
          FROM (SELECT *, {table}::UBIGINT[] AS crcs, list_transform(range(1, n + 1), lambda y: array_slice(t, y, y)::BIT::UTINYINT::UBIGINT) AS bytes FROM d)),
    a AS (SELECT c.*, s.b::INT AS shard, g.b::INT AS grown_shard FROM c JOIN s ON c.doc_id IS NOT DISTINCT FROM s.id AND s.n = {sharding.SHARDS} JOIN s g ON c.doc_id IS NOT DISTINCT FROM g.id AND g.n = {sharding.SHARDS + 1})
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM a
    """


def simhash_components() -> str:
    """XXH64 of every shingle, majorities of its bits, and what is reached by links over all pairs."""
    x, seed = _Xx64(), simhash.SEED

    def lane(at: str, n: int) -> str:
        kind = {8: "UBIGINT", 4: "UINTEGER", 1: "UTINYINT"}[n]
        return "(" + " || ".join(f"array_slice(s, {at} + {k}, {at} + {k})" for k in range(n, 0, -1)) + f")::BIT::{kind}::UHUGEINT"

    big, step, whole = x.big, x.step, x.WHOLE
    p1, p2, p5 = x.P1, x.P2, x.P5
    joined = x.add(x.add(x.turn("a", 1), x.turn("b", 7)), x.add(x.turn("c", 12), x.turn("d", 18)))
    for v in "abcd":
        joined = x.merged(joined, v)
    eight, four, one, last = x.eight("h", lane("o", 8)), x.four("h", lane("o", 4)), x.one("h", lane("o", 1)), x.last("h")
    words = r"[^\x20\x09-\x0D]+"
    return f"""
    WITH RECURSIVE t AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{words}') AS ws FROM documents),
    k AS MATERIALIZED (
        SELECT r, encode(array_to_string(ws[i:i + {simhash.SHINGLE - 1}], ' ')) AS s
        FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - {simhash.SHINGLE - 1}) + 1)) AS i FROM t WHERE len(ws) > 0)),
    z AS MATERIALIZED (SELECT DISTINCT s FROM k),
    x AS (
        SELECT s, octet_length(s) AS n, 0 AS o, {big(seed + p1 + p2)} AS a, {big(seed + p2)} AS b, {big(seed)} AS c, {big(seed - p1)} AS d FROM z
        UNION ALL
        SELECT s, n, o + 32, {step("a", lane("o", 8))}, {step("b", lane("(o + 8)", 8))}, {step("c", lane("(o + 16)", 8))}, {step("d", lane("(o + 24)", 8))} FROM x WHERE o + 32 <= n),
    y AS (
        SELECT s, n, o, (CASE WHEN n >= 32 THEN {joined} ELSE {big(seed + p5)} END + n::UHUGEINT) % {whole} AS h FROM x WHERE o + 32 > n
        UNION ALL
        SELECT s, n, CASE WHEN o + 8 <= n THEN o + 8 WHEN o + 4 <= n THEN o + 4 ELSE o + 1 END, CASE WHEN o + 8 <= n THEN {eight} WHEN o + 4 <= n THEN {four} ELSE {one} END FROM y WHERE o < n),
    h AS MATERIALIZED (SELECT s, {last} AS h FROM y WHERE o = n),
    b AS (SELECT r, count(*) AS n, {", ".join(f"count(*) FILTER ((h // {1 << i}::UHUGEINT) % 2 = 1) AS b{i}" for i in range(64))} FROM k JOIN h USING (s) GROUP BY r),
    f AS MATERIALIZED (SELECT t.r, doc_id, ({" + ".join(f"CASE WHEN 2 * coalesce(b{i}, 0) > n THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END" for i in range(64))})::UBIGINT AS fp FROM t LEFT JOIN b ON t.r = b.r),
    p AS MATERIALIZED (SELECT DISTINCT fp FROM f),
    e AS MATERIALIZED (SELECT p.fp AS a, q.fp AS b FROM p, p q WHERE bit_count(xor(p.fp, q.fp)) <= {simhash.RADIUS} AND p.fp <> q.fp),
    w AS (SELECT fp AS a, fp AS b FROM p UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
    m AS (SELECT w.a, min(doc_id) AS component_id FROM w JOIN f ON w.b = f.fp GROUP BY w.a)
    SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM f JOIN m ON f.fp = m.a
    """


#: Every window that holds a benchmark shingle, so no fingerprint is needed; what lies outside the SimHash's radius would be in here alone.
CONTAMINATION = f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL),
    b AS (SELECT row_number() OVER () AS b, item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM benchmark WHERE text IS NOT NULL),
    i AS MATERIALIZED (SELECT *, least({decontaminate.SHINGLE}, len(ws)) AS w, len(ws) - least({decontaminate.SHINGLE}, len(ws)) + 1 AS n FROM b WHERE len(ws) > 0),
    g AS MATERIALIZED (SELECT b, w, n, gram, count(*) AS c FROM (SELECT b, w, n, array_to_string(ws[k:k + w - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM i)) GROUP BY ALL),
    x AS (SELECT r, w, len(ws) - w + 1 AS l, k - 1 AS p, array_to_string(ws[k:k + w - 1], ' ') AS gram
          FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS k FROM d, (SELECT DISTINCT w FROM i) WHERE len(ws) >= w)),
    h AS MATERIALIZED (SELECT r, b, n, l, p, gram, c FROM x JOIN g USING (w, gram)),
    s AS (SELECT *, unnest(range(greatest(0, p - n + 1), least(p, l - n) + 1)) AS s FROM h),
    m AS (SELECT r, b, n, s, sum(same) AS same FROM (SELECT r, b, n, s, gram, least(count(*), any_value(c)) AS same FROM s GROUP BY r, b, n, s, gram) GROUP BY r, b, n, s),
    f AS (SELECT r, b, s, same / (2 * n - same) AS alike FROM m WHERE same / (2 * n - same) >= {decontaminate.SIMILARITY} QUALIFY row_number() OVER (PARTITION BY r, b ORDER BY alike DESC, s) = 1)
    SELECT doc_id, item_id, round(alike, 6) AS similarity, s AS start_word FROM f JOIN d USING (r) JOIN i USING (b)
"""

ORACLE_SQL = {"op1_url_templates": url_templates(), "op2_jump_shards": jump_shards(), "op4_warc_revisits": WARC, "op6_pigeonring_simhash": simhash_components(), "op7_decontamination": CONTAMINATION, "op8_disclosure_pii": disclosure(), "op9_bwt_repeats": REPEATS}
