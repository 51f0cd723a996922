"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from parcelwatch.llm import licenses, quality_rules


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_text(licenses.BESIDE)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {_text(licenses.COPYRIGHT_LINE)}, {_text(chr(92) + '1')}, 'g')"
    for spelling, same in licenses.SAME:
        out = f"replace({out}, {_text(spelling)}, {_text(same)})"
    out = f"trim(regexp_replace({out}, {_text('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, ' ', 'g'))"
    for spelling, same in licenses.SAME_WORDS:
        out = f"replace({out}, {_text(spelling)}, {_text(same)})"
    return out


def _licenses() -> str:
    known = ", ".join(f"({_text(i)}, {_text(t)})" for i, t in licenses.KNOWN)
    return f"""
        WITH known AS (
          SELECT sha256({_canonical('t')}) AS digest, min(i) AS license_id FROM (VALUES {known}) AS v(i, t) GROUP BY 1),
        docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        line AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs),
        stated AS (
          SELECT row, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
          FROM line JOIN known ON sha256({_canonical('line')}) = digest
          WHERE regexp_matches(line, {_text(licenses.ABOUT)}) GROUP BY row)
        SELECT doc_id, sha256({_canonical('text')}) AS text_digest, license_id AS text_license,
               coalesce(n, 0) AS n_license_lines, coalesce(ids, '') AS line_licenses
        FROM docs LEFT JOIN known ON sha256({_canonical('text')}) = digest LEFT JOIN stated USING (row)
    """


def _rules() -> str:
    r = quality_rules
    count = "len(regexp_extract_all({}, {}))".format
    marks, bars, words = (count("line", _text(p)) for p in (r.MARKS, r.SEPARATORS, "[^ \\t-\\r]+"))
    return f"""
        WITH docs AS (
          SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
                 list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words,
                 string_split(coalesce(text, ''), chr(10)) AS lines
          FROM documents),
        windows AS (
          SELECT row, i, array_to_string(words[i:i + 7], ' ') AS w
          FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM docs)),
        twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM windows),
        places AS (SELECT row, i, lag(i) OVER (PARTITION BY row ORDER BY i) AS before FROM twice WHERE n > 1),
        repeats AS (SELECT row, sum(least(8, i - coalesce(before, -8))) AS n FROM places GROUP BY row),
        line AS (SELECT row, unnest(lines) AS line FROM docs),
        judged AS (
          SELECT row, line, ({marks} >= {r.MIN_MARKS} AND {marks} * 100 > length(line) * {r.MARK_PERCENT})
            OR ({bars} >= {r.MIN_SEPARATORS} AND {bars} * 100 > {words} * {r.SEPARATOR_PERCENT})
            OR regexp_matches(line, {_text(r.BOILERPLATE)}) AS bad
          FROM line),
        by_row AS (
          SELECT row, count(*) FILTER (WHERE regexp_matches(line, '[^ \\t-\\r]'))
                   - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '[^ \\t-\\r]')) AS n_dup_lines,
                 coalesce(sum(length(line) + 1) FILTER (WHERE NOT bad), 0) AS good
          FROM judged GROUP BY row),
        counted AS (
          SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                 CAST({count('text', _text(r.SYMBOLS))} AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
                 length(text) AS size, length(text) - greatest(good - 1, 0) AS lost
          FROM docs JOIN by_row USING (row) LEFT JOIN repeats USING (row)),
        failed AS (
          SELECT *, n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.REPEAT_PERCENT} * n_words AS base_failed FROM counted)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND lost * 100 <= size * {r.LOSS_PERCENT} AS kept
        FROM failed
    """


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _collocations() -> str:
    # Cuts of a phrase: its first k words and the rest.
    return f"""
        WITH piece AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece
          FROM documents),
        word AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece),
        start AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM word),
        total AS (SELECT lang, count(*) AS n FROM start GROUP BY lang),
        gram AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS f
                 FROM start CROSS JOIN (VALUES (1), (2), (3)) AS size(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
        candidate AS (SELECT lang, g, f AS a FROM gram WHERE len(g) > 1 AND f >= 10),
        cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM candidate),
        part AS (
          SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r,
                 CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
          FROM cut c JOIN gram x ON x.lang = c.lang AND x.g = c.g[:k] JOIN gram y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
        best AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        inside AS (
          SELECT lang, g, max(a) AS longer FROM (
            SELECT lang, g[:2] AS g, a FROM candidate WHERE len(g) = 3 UNION ALL
            SELECT lang, g[2:] AS g, a FROM candidate WHERE len(g) = 3) GROUP BY ALL),
        kept AS (
          SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score
          FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE longer IS NULL OR 100 * longer < 50 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """


def _contamination() -> str:
    words = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
        asked AS (
          SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS words
          FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
                FROM item WHERE len(w) > 0)),
        docs AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
        places AS (
          SELECT row, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
          FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i
                FROM docs CROSS JOIN (SELECT DISTINCT k FROM asked) WHERE len(w) >= k)),
        found AS (SELECT row, i, k, item FROM places JOIN asked USING (k, words)),
        hit AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + k)) AS place FROM found) GROUP BY row),
        items AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
                  FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
        FROM docs LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
    """


def _manifest() -> str:
    def leaf(text: str) -> str:
        fields = (f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text))
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    # CRC-32 bit by bit: -1 stands for a shift; the last bit is inverted at the end.
    shifts = ", ".join(["-1"] * 8)
    crc = (
        f"list_reduce(list_prepend(4294967295, flatten([[ord(c), {shifts}] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])), "
        "LAMBDA x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)"
    )
    up = """
        SELECT level + 1, tree, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
        FROM {0} WHERE n > 1 GROUP BY level, tree, idx // 3, n
    """
    # For a leaf and each level: the siblings before and behind its own node.
    steps = """
        SELECT l.tree, l.idx, u.level,
               coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (WHERE u.idx < l.idx // power), '') AS before,
               coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (WHERE u.idx > l.idx // power), '') AS behind
        FROM (SELECT tree, idx FROM {0} WHERE level = 0) l
        JOIN (SELECT *, CAST(pow(3, level) AS BIGINT) AS power FROM {0} WHERE n > 1) u
          ON u.tree = l.tree AND u.idx // 3 = l.idx // power // 3
        GROUP BY ALL
    """
    return f"""
        WITH RECURSIVE docs AS (
          SELECT row_number() OVER () AS row, doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree,
                 {leaf('text')} AS leaf,
                 CASE WHEN {crc} & 1 = 1 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS changed
          FROM documents),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS idx,
                 count(*) OVER (PARTITION BY tree) AS n FROM docs),
        lower(level, tree, idx, n, digest) AS (
          SELECT 0, tree, idx, n, leaf FROM placed UNION ALL {up.format('lower')}),
        sources AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM lower WHERE n = 1),
        upper(level, tree, idx, n, digest) AS (
          SELECT 0, '', idx, n, digest FROM sources UNION ALL {up.format('upper')}),
        below AS ({steps.format('lower')}), above AS ({steps.format('upper')}),
        path AS (
          SELECT tree, idx, 0 AS half, level, before, behind FROM below UNION ALL
          SELECT p.tree, p.idx, 1, a.level, before, behind FROM placed p JOIN sources s ON s.tree = p.tree JOIN above a ON a.idx = s.idx),
        proof AS (
          SELECT tree, idx, string_agg(before || behind, '' ORDER BY half, level) AS siblings,
                 list(before || '|' || behind ORDER BY half, level) AS steps FROM path GROUP BY tree, idx),
        folded AS (
          SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
                 list_reduce(list_prepend(p.changed, coalesce(steps, [])),
                             LAMBDA x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
          FROM placed p JOIN sources s ON s.tree = p.tree CROSS JOIN (SELECT digest FROM upper WHERE n = 1) r
          LEFT JOIN proof f ON f.tree = p.tree AND f.idx = p.idx)
        SELECT *, folded_root = root AS verified FROM folded
    """


ORACLES: dict[str, str] = {
    "op1_license_scan": _licenses(),
    "op7_quality_rules": _rules(),
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_collocations": _collocations(),
    "op12_decontamination": _contamination(),
    "op13_merkle_manifest": _manifest(),
}
