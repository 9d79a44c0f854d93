"""SQL forms of the corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

import math

from . import mixing, quality_rules, warc

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def near_dedup(k: int = 3, percent: int = 85) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: {gram}) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
    d AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT d.y, r.root FROM r JOIN d ON r.doc_id = d.x AND r.root < d.y)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, doc_id = m.root AS kept FROM (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m LEFT JOIN n USING (doc_id)"""


def quality() -> str:
    metrics, g = quality_rules.METRICS, math.log(quality_rules.GAMMA)
    pairs = ", ".join(f"{{'metric': '{m}', 'value': {m}}}" for m in (*metrics, quality_rules.LENGTH))
    events = " ".join(f"WHEN '{m}' THEN {10_000.0 * v}" for m, v in metrics.items())
    passed = " AND ".join(f"coalesce({m} <= max_{m}, TRUE)" for m in metrics)
    picks = ", ".join(f"max(fence) FILTER (metric = '{m}') AS max_{m}" for m in metrics)
    value = lambda b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE pow({quality_rules.GAMMA}, ({b} - 1)::DOUBLE) END"

    def fences(name: str, keys: str) -> str:
        part = f"{keys}, metric" if keys else "metric"
        q = lambda p: f"min(bucket) FILTER (cum >= ceil(size * {p}::DOUBLE))"
        same = " AND ".join(f"a.{k} = l.{k}" for k in keys.split(", ")) if keys else "TRUE"
        mine = ", ".join(f"a.{k}" for k in part.split(", "))
        return f"""{name}_q AS (SELECT {part}, any_value(size) AS size, {value(q(0.25))} AS q1, {value(q(0.75))} AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {part}) AS size FROM (SELECT {part}, bucket, sum(n) AS n FROM fine GROUP BY ALL)) GROUP BY {part}),
    {name} AS (SELECT {mine}, a.size, CAST(floor(a.q3 + {quality_rules.FENCE} * greatest(a.q3 - a.q1, (CASE a.metric {events} END)::DOUBLE / greatest(1.0, l.q1))) AS BIGINT) AS fence
      FROM {name}_q a JOIN {name}_q l ON l.metric = '{quality_rules.LENGTH}' AND a.metric <> '{quality_rules.LENGTH}' AND {same})"""

    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, {WORDS} AS w FROM documents),
    win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY 1),
    b AS (SELECT doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
    j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(floor(n_symbols * 10000 / greatest(n_words, 1)::DOUBLE) AS BIGINT) AS symbol_rate, CAST(floor(n_dup_lines * 10000 / greatest(n_words, 1)::DOUBLE) AS BIGINT) AS dup_line_rate,
      CAST(floor(n_repeat_words * 10000 / greatest(n_words, 1)::DOUBLE) AS BIGINT) AS repeat_rate, CAST(floor(word_chars * 10000 / greatest(n_words, 1)::DOUBLE) AS BIGINT) AS long_word_rate FROM b),
    fine AS (SELECT lang, source, p.metric AS metric, CASE WHEN p.value <= 0 THEN 0 ELSE 1 + CAST(ceil(ln(p.value::DOUBLE) / {g!r}::DOUBLE) AS BIGINT) END AS bucket, count(*) AS n FROM (SELECT lang, source, unnest([{pairs}]) AS p FROM j WHERE NOT base_failed) GROUP BY ALL),
    {fences("fa", "lang, source")},
    {fences("fb", "lang")},
    {fences("fc", "")},
    chosen AS (SELECT lang, source, {picks} FROM (SELECT fa.lang, fa.source, metric, CASE WHEN fa.size >= {quality_rules.LEAST_GROUP} THEN fa.fence WHEN fb.size >= {quality_rules.LEAST_GROUP} THEN fb.fence ELSE fc.fence END AS fence FROM fa JOIN fb USING (lang, metric) JOIN fc USING (metric)) GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passed} AS kept FROM j LEFT JOIN chosen USING (lang, source)"""


def mix() -> str:
    w = len(mixing.WEIGHTS)
    draw = lambda key, salt: f"CAST('0x' || substr(md5('{mixing.SEED}:{salt}:' || coalesce(({key})::VARCHAR, '')), 1, 8) AS BIGINT)"

    def sainte_lague(name: str, votes: str, group: str, key: str) -> str:
        part = f"PARTITION BY {group}" if group else ""
        head = f"{group}, " if group else ""
        on = f"{head}{key}"
        return f"""{name}_v AS (SELECT *, sum(votes) OVER ({part}) AS _all, count(*) OVER ({part}) AS _keys FROM {votes}),
    {name}_m AS (SELECT *, CASE WHEN _all > 0 THEN votes * seats_all / _all ELSE 0.0 END AS _fair, CAST(ceil(CASE WHEN _all > 0 THEN _keys * votes / _all ELSE 0.0 END) AS BIGINT) + 2 AS _margin FROM {name}_v),
    {name}_b AS (SELECT *, greatest(0, CAST(round(_fair) AS BIGINT) - _margin) AS _base FROM {name}_m),
    {name}_l AS (SELECT *, seats_all - sum(_base) OVER ({part}) AS _left FROM {name}_b),
    {name}_t AS (SELECT {on}, votes, _left, unnest(range(_base, _base + 2 * _margin + 1)) AS _k FROM {name}_l WHERE votes > 0),
    {name}_w AS (SELECT {on}, count(*) AS won FROM (SELECT *, row_number() OVER ({part} ORDER BY votes / (2 * _k + 1) DESC, {key} NULLS LAST, _k) AS p FROM {name}_t) WHERE p <= _left GROUP BY ALL),
    {name} AS (SELECT l.*, l._base + coalesce(x.won, 0) AS seats FROM {name}_l l LEFT JOIN {name}_w x ON {" AND ".join(f"l.{c.strip()} IS NOT DISTINCT FROM x.{c.strip()}" for c in on.split(","))})"""

    return f"""WITH sized AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
    by_src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY 1),
    wt AS (SELECT *, {list(mixing.WEIGHTS)}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {w} AS INT) + 1] AS weight, source_size * {mixing.MOST} AS cap FROM by_src),
    lv AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.PERCENT} / 100 AS budget, coalesce(sum(cap) OVER wat, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER wat, 0) AS opened, row_number() OVER (ORDER BY cap / weight::DOUBLE, source NULLS LAST) AS nth
      FROM wt WINDOW wat AS (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    lw AS (SELECT *, (budget - filled::DOUBLE) / opened::DOUBLE AS level FROM lv),
    tg AS (SELECT source, source_size, n_docs, weight, least(cap::DOUBLE, coalesce((SELECT min_by(level, nth) FROM lw WHERE level * weight <= cap) * weight, cap::DOUBLE)) AS target FROM lw),
    bl AS (SELECT *, target AS votes, greatest(1, least(4096, CAST(floor(coalesce(min(target) FILTER (target > 0) OVER (), 1.0) / 500) AS BIGINT))) AS block FROM tg),
    bs AS (SELECT *, CAST(round(sum(target) OVER () / block) AS BIGINT) AS seats_all FROM bl),
    {sainte_lague("src", "bs", "", "source")},
    dealt AS (SELECT d.*, s.source_size, s.target, s.block, s.seats AS source_blocks, {draw("coalesce(d.doc_id::VARCHAR, 'size ' || d.size)", "shard")} % greatest(1, CAST(ceil(s.n_docs / {mixing.SHARD_DOCS}::DOUBLE) AS BIGINT)) AS shard, {draw("d.doc_id", "order")} AS ord FROM sized d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
    piles AS (SELECT source, shard, shard // {mixing.SHELF_SHARDS} AS shelf, CAST(sum(size) AS BIGINT) AS shard_size, CAST(sum(size) AS DOUBLE) AS votes, any_value(source_blocks) AS source_blocks, any_value(block) AS block FROM dealt GROUP BY 1, 2),
    shelves AS (SELECT source, shelf, sum(votes) AS votes, any_value(source_blocks) AS seats_all FROM piles GROUP BY 1, 2),
    {sainte_lague("sf", "shelves", "source", "shelf")},
    shards AS (SELECT p.*, sf.seats AS seats_all FROM piles p JOIN sf ON p.source IS NOT DISTINCT FROM sf.source AND p.shelf = sf.shelf),
    {sainte_lague("sh", "shards", "source, shelf", "shard")},
    q AS (SELECT *, least(seats * block, shard_size * {mixing.MOST}) AS quota FROM sh),
    qq AS (SELECT source, shard, shard_size, CASE WHEN shard_size > 0 THEN quota // shard_size ELSE 0 END AS passes, CASE WHEN shard_size > 0 THEN quota % shard_size ELSE 0 END AS rest,
      CASE WHEN shard_size > 0 THEN ({draw("coalesce(source, '') || ':' || shard", "start")} % greatest(1, shard_size // block)) * block ELSE 0 END AS start FROM q),
    laid AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY ord, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS fin FROM dealt)
    SELECT doc_id, size, l.source_size, target, CAST(size * passes + greatest(0, least(fin, least(start + rest, shard_size)) - greatest(fin - size, start)) + greatest(0, least(fin, greatest(0, start + rest - shard_size)) - greatest(fin - size, 0)) AS BIGINT) AS taken
    FROM laid l JOIN qq ON l.source IS NOT DISTINCT FROM qq.source AND l.shard = qq.shard"""


def derivatives() -> str:
    text = "html"
    for pattern, by in warc.STEPS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, 'g')"
    for name, char in warc.ENTITIES[:-1]:
        text = f"replace({text}, {quoted(name)}, {quoted(char)})"
    number = "regexp_extract(p, '^([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});', 1)"
    value = f"(CASE WHEN lower(substr({number}, 1, 1)) = 'x' THEN CAST('0x' || substr({number}, 2) AS BIGINT) ELSE TRY_CAST({number} AS BIGINT) END)"
    char = f"CASE WHEN {value} > 0 AND {value} < 1114112 AND {value} NOT BETWEEN 55296 AND 57343 THEN chr(CAST({value} AS INT)) ELSE chr({ord(warc.NO_CHARACTER)}) END"
    part = f"CASE WHEN {number} = '' THEN '&#' || p ELSE {char} || substr(p, length({number}) + 2) END"
    text = f"(SELECT s[1] || coalesce(array_to_string(list_transform(s[2:], lambda p: {part}), ''), '') FROM (SELECT string_split({text}, '&#') AS s))"
    text = f"replace({text}, {quoted(warc.ENTITIES[-1][0])}, {quoted(warc.ENTITIES[-1][1])})"
    for pattern, by in warc.SPACES:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, 'g')"
    urn = lambda x: f"(SELECT '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' FROM (SELECT md5({x}) AS h))"
    digest = lambda x: f"(SELECT 'sha1:' || array_to_string(list_transform(range(0, 32), lambda i: substr('{warc.BASE32}', CAST((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31 AS INT) + 1, 1)), '') FROM (SELECT sha1({x}) AS h))"
    crlf = "chr(13) || chr(10)"
    http = f"'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf}"
    header = " || ".join(f"'{name}: ' || {c}::VARCHAR || {crlf}" for name, c in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", f"'{warc.NO_DATE}'"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", f"'{warc.NO_DATE}'"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")))
    return f"""WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
    s AS (SELECT *, {urn("'response' || chr(10) || page_id || chr(10) || target_uri")} AS refers_to, trim({text}, ' ' || chr(10)) AS txt, {digest("html")} AS payload_digest, {digest(f"{http} || {crlf} || html")} AS source_digest FROM p),
    c AS (SELECT *, {urn("'conversion' || chr(10) || refers_to")} AS conversion, {urn("'metadata' || chr(10) || refers_to")} AS metadata FROM s),
    r AS (SELECT page_id, 'conversion' AS record_type, conversion AS record_id, refers_to, target_uri, 'text/plain' AS content_type, payload_digest, txt AS block FROM c
      UNION ALL SELECT page_id, 'metadata', metadata, refers_to, target_uri, 'application/warc-fields', payload_digest, 'source-record-id: ' || refers_to || {crlf} || 'conversion-record-id: ' || conversion || {crlf} || 'source-status: 200' || {crlf} || 'source-content-type: text/html; charset=utf-8' || {crlf}
        || 'source-block-digest: ' || source_digest || {crlf} || 'source-payload-digest: ' || payload_digest || {crlf} || 'source-payload-length: ' || octet_length(encode(html)) || {crlf} || 'source-header: HTTP/1.1 200 OK' || {crlf} || ' Content-Type: text/html; charset=utf-8' || {crlf} FROM c),
    d AS (SELECT *, octet_length(encode(block)) AS content_length, {digest("block")} AS block_digest FROM r)
    SELECT page_id, record_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, payload_digest, md5('WARC/1.1' || {crlf} || {header}) AS header_md5, block FROM d"""


def vector_code_rows() -> str:
    from . import vector_codes as V

    between = lambda v, c: f"list_sum(list_transform(range(1, len({v}) + 1), lambda i: ({v}[i] - {c}[i]) * ({v}[i] - {c}[i])))"
    steps = [f"""k AS (SELECT vec_id, label, [CAST(least(greatest(floor(x::DOUBLE * {V.SCALE}), -{V.TOP}), {V.TOP}) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
    f"x AS (SELECT vec_id, label, p, v[p * (len(v) // {V.PARTS}) + 1 : (p + 1) * (len(v) // {V.PARTS})] AS v FROM k, (SELECT unnest(range({V.PARTS})) AS p))",
    f"b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM x QUALIFY e < {V.ENTRIES})"]
    near = lambda book: f"SELECT vec_id, any_value(label) AS label, x.p, any_value(v) AS v, min({between('v', 'c')} * {V.ENTRIES} + e) AS best FROM x JOIN {book} b ON x.p = b.p GROUP BY vec_id, x.p"
    for r in range(V.ROUNDS):
        steps += [f"a{r} AS ({near(f'b{r}')})", f"s{r} AS (SELECT p, best % {V.ENTRIES} AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY p, best % {V.ENTRIES}, i)",
                  f"m{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY p, e)", f"b{r + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e))"]
    return f"""WITH {", ".join(steps)}, z AS ({near(f"b{V.ROUNDS}")}),
    o AS (SELECT vec_id, label, string_agg(printf('%02x', (best % {V.ENTRIES})::INT), '' ORDER BY p) AS code, sum(best // {V.ENTRIES})::BIGINT AS error FROM z GROUP BY vec_id, label),
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{V.ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h"""


def lexical_rows() -> str:
    from . import lexical as L

    terms = lambda t: f"unnest(regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{L.BETWEEN.replace('[', '[^', 1)}'))"
    return f"""WITH d AS (SELECT doc_id, {terms("text")} AS term FROM documents), q AS (SELECT DISTINCT item_id, {terms("text")} AS term FROM benchmark),
    p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL), t AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM l),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, t GROUP BY term),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN l USING (doc_id), t GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {L.TOP}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": derivatives(), "op4_near_dedup": near_dedup(), "op8_mixing": mix(), "op9_quality_rules": quality(), "op11_vector_codes": vector_code_rows(), "op13_lexical_search": lexical_rows()}
