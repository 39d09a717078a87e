"""SQL for DuckDB of the operators whose statements are made of parts."""

from __future__ import annotations

from millrace.llm import license_scan, resampling

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's bytes, bytewise with a table computed in the statement."""
    table = ", ".join(str(int(entry)) for entry in resampling.TABLE)
    octets = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, ([{table}]::BIGINT[])[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce({octets}, {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_scans() -> str:
    phrases = ", ".join(
        f"({_quoted(label)}, string_split({_quoted(phrase)}, ' '))" for phrase, label in license_scan.PHRASES.items()
    )
    templates = ", ".join(
        f"({e.size}, {e.needed}, {_quoted(e.label)}, [{', '.join(_quoted(w.decode()) for w in e.words)}])"
        for e in license_scan.entries(license_scan.TEMPLATES)
    )
    return f"""
        WITH words AS MATERIALIZED (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
        phrase(label, p) AS (VALUES {phrases}),
        place AS MATERIALIZED (
            SELECT doc_id, i - 1 AS start, label
            FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) JOIN phrase
                 ON w[i] = p[1] AND w[i : i + len(p) - 1] = p),
        base AS (
            SELECT doc_id, count(*) AS n, min(start) AS low, max(start) AS high, list(DISTINCT label) AS labels
            FROM place GROUP BY doc_id),
        template(size, needed, label, t) AS (VALUES {templates}),
        block AS MATERIALIZED (
            SELECT doc_id, size, b, list_distinct(w[b * size + 1 : (b + 2) * size]) AS held
            FROM (SELECT doc_id, w, size, unnest(range(0, (len(w) + size - 1) // size)) AS b
                  FROM words, (SELECT DISTINCT size FROM template))),
        met AS MATERIALIZED (
            SELECT doc_id, size, b, label, len(list_intersect(held, t)) AS shared, len(t) AS n
            FROM block JOIN template USING (size) WHERE len(list_intersect(held, t)) >= needed),
        best AS (
            SELECT doc_id, label, shared / n AS share FROM met
            QUALIFY rank() OVER (PARTITION BY doc_id, size, b ORDER BY shared / n DESC, shared DESC) = 1),
        found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM best GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, low AS first_word, high AS last_word,
               coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(
                   coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
               CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
        FROM words LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


def importance_resampling() -> str:
    n = resampling.BUCKETS
    grams = " UNION ALL ".join(
        f"SELECT k, doc_id, {' || chr(32) || '.join(f'w[i + {j}]' for j in range(size))} AS f "
        f"FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM words)"
        for size in range(1, resampling.GRAMS + 1)
    )
    return f"""
        WITH words AS MATERIALIZED (
            SELECT 'd' AS k, doc_id, coalesce({WORDS}, []) AS w FROM documents
            UNION ALL SELECT 't', item_id, coalesce({WORDS}, []) FROM benchmark),
        feature AS MATERIALIZED (SELECT k, doc_id, f, count(*) AS c FROM ({grams}) GROUP BY ALL),
        bucket AS MATERIALIZED (SELECT f, {crc32('f')} % {n} AS b FROM (SELECT DISTINCT f FROM feature)),
        counted AS MATERIALIZED (
            SELECT b, coalesce(sum(c) FILTER (WHERE k = 'd'), 0)::DOUBLE AS s,
                   coalesce(sum(c) FILTER (WHERE k = 't'), 0)::DOUBLE AS t
            FROM feature JOIN bucket USING (f) GROUP BY b),
        gain AS (
            SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + {n}) / ((s + 1) * (sum(t) OVER () + {n}))))::BIGINT AS g
            FROM counted),
        weight AS (
            SELECT doc_id, sum(c * g)::BIGINT AS weight
            FROM feature JOIN bucket USING (f) JOIN gain USING (b) WHERE k = 'd' GROUP BY doc_id),
        scored AS (
            SELECT doc_id, len(w) AS m, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln(
                       (('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                       / 4294967296::DOUBLE)))::BIGINT AS score
            FROM words LEFT JOIN weight USING (doc_id) WHERE k = 'd'),
        ordered AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
                   {resampling.PERCENT} * count(*) OVER () // 100 AS drawn
            FROM scored WHERE m >= {resampling.LEAST_WORDS})
        SELECT doc_id, (m + greatest(m - 1, 0) + greatest(m - 2, 0))::BIGINT AS n_features, weight, score,
               CASE WHEN place <= drawn THEN place END AS rank
        FROM scored LEFT JOIN ordered USING (doc_id)"""


def _tree(name: str, levels: int) -> str:
    """CTEs of a forest's levels: node digests, and what stands left and right of a node in its run."""
    parts = []
    for k in range(levels):
        run = f"PARTITION BY key, pos // 8 ORDER BY pos ROWS BETWEEN"
        parts.append(
            f"""{name}_side{k} AS MATERIALIZED (
                SELECT key, pos, n,
                       coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                       coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM {name}{k}),
            {name}{k + 1} AS MATERIALIZED (
                SELECT key, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n,
                       CASE WHEN any_value(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d
                FROM {name}{k} GROUP BY key, pos // 8)"""
        )
    return ", ".join(parts)


def _climb(name: str, levels: int, start: str, place: str, key: str) -> str:
    """CTEs that carry each leaf's proof and fold up a forest."""
    parts, before = [], start
    for k in range(levels):
        parts.append(
            f"""{name}_up{k} AS (
                SELECT x.* REPLACE (
                    x.proof || s.l || s.r AS proof,
                    CASE WHEN s.n = 1 THEN x.fold ELSE sha256(s.l || x.fold || s.r) END AS fold)
                FROM {before} x JOIN {name}_side{k} s ON s.key = x.{key} AND s.pos = x.{place} // {8 ** k})"""
        )
        before = f"{name}_up{k}"
    return ", ".join(parts)


def merkle_manifest(leaf_levels: int = 9, language_levels: int = 4) -> str:
    """For up to 8 to the 9th documents a language and 8 to the 4th languages."""

    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    tampered = f"CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN {LOWER.format('text')} ELSE text END"
    return f"""
        WITH doc AS MATERIALIZED (
            SELECT doc_id, coalesce('=' || lang, '') AS key, {leaf('text')} AS leaf, {leaf('found')} AS fold
            FROM (SELECT *, {tampered} AS found FROM documents)),
        placed AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY key) AS n
            FROM doc),
        low0 AS MATERIALIZED (SELECT key, pos, n, leaf AS d FROM placed),
        {_tree('low', leaf_levels)},
        high0 AS MATERIALIZED (
            SELECT '' AS key, key AS name, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n, d
            FROM low{leaf_levels}),
        {_tree('high', language_levels)},
        start AS (
            SELECT placed.*, '' AS proof, h.pos AS lang_pos, h.d AS subroot, '' AS top
            FROM placed JOIN high0 h ON h.name = placed.key),
        {_climb('low', leaf_levels, 'start', 'pos', 'key')},
        {_climb('high', language_levels, f'low_up{leaf_levels - 1}', 'lang_pos', 'top')}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
        FROM high_up{language_levels - 1}, (SELECT d AS root FROM high{language_levels})"""


def warc(min_bytes: int) -> str:
    """Records of ``pages`` with the digest in base 32: five hex digits of a SHA-1 give four."""
    group = "('0x' || substr(hash, 5 * (j // 4) + 1, 5))::BIGINT"
    digit = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({group} >> (15 - 5 * (j % 4))) & 31) + 1, 1)"
    return f"""
        WITH record AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hash,
                   strlen(coalesce(html, ''))::BIGINT AS n,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
            FROM pages)
        SELECT page_id, n AS payload_bytes,
               array_to_string(list_transform(range(32), lambda j: {digit}), '') AS payload_digest,
               CASE WHEN n < {min_bytes} OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n >= {min_bytes} AND page_id <> first THEN first END AS refers_to
        FROM record"""
