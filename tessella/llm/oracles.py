"""DuckDB SQL for the queries that SQL can express, made from the operators' own constants."""

from __future__ import annotations

from tessella.llm import licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_scan(cover: float = 0.8, slack: int = 2) -> str:
    """Hits of word pairs, votes by diagonal, merged diagonals, spans."""
    told = [*licenses.BASE, *licenses.TEMPLATES]
    pairs = ", ".join(f"({i}, {at}, {len(w)}, '{w[at]}', '{w[at + 1]}')" for i, (phrase, _) in enumerate(told) for w in [phrase.split()] for at in range(len(w) - 1))
    labels = ", ".join(f"({i}, '{label}', {str(i < len(licenses.BASE)).lower()})" for i, (_, label) in enumerate(told))
    return rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, doc_id,
                list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents
        ), pairs(template, t, size, tw, tnext) AS (VALUES {pairs}), named(template, label, base) AS (VALUES {labels}),
        grams AS (SELECT row, unnest(range(0, len(w) - 1)) AS p, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM docs WHERE len(w) > 1),
        hits AS (SELECT row, template, size, t, p - t AS diagonal FROM grams JOIN pairs ON a = tw AND b = tnext),
        apart AS (
            SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) AS gap FROM (SELECT DISTINCT row, template, size, diagonal FROM hits)
        ), grouped AS (
            SELECT row, template, diagonal, sum(CASE WHEN gap IS NULL OR size <= 6 OR gap > {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY row, template ORDER BY diagonal) AS g FROM apart
        ), spans AS (
            SELECT row, template, min(diagonal + t) AS first, count(DISTINCT t) / (any_value(size) - 1) AS share, any_value(size) AS size
            FROM hits JOIN grouped USING (row, template, diagonal) GROUP BY row, template, g
        ), found AS (
            SELECT row, max(share) AS best,
                count(*) FILTER (WHERE base AND share = 1) AS n_base, min(first) FILTER (WHERE base AND share = 1) AS first_word, max(first) FILTER (WHERE base AND share = 1) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND share = 1) AS base_labels,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE CASE WHEN size <= 6 THEN share = 1 ELSE share >= {cover} END) AS labels
            FROM spans JOIN named USING (template) GROUP BY row
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(best, 0.0) AS score
        FROM docs LEFT JOIN found USING (row)
    """


def url_filter(rules: list[str], levels: int = 3, min_children: int = 8, rows_per_child: float = 4.0, literal_share: float = 0.05, literal_rows: int = 20, smoothing: float = 5.0, z: float = 1.96, reject_at: float = 0.8, known_from: float = 0.5) -> str:
    """The template tree level by level, merged siblings, and smoothed purity, for paths of `levels` segments at most.

    It is written out level by level; the tables' paths have two segments, or three where they end in a slash.
    """
    cases = []
    for line in sorted(rules, key=lambda x: -len(x.split()[1])):
        verdict, where = line.split()
        host, _, path = where.partition("/")
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", where, verdict))
    case = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[i]}'" for c in cases) + " END"
    tree, shapes = "", ""
    for n in range(1, levels + 1):
        tree += rf""", s{n} AS (SELECT *, CASE WHEN len(parts) >= {n} THEN parts[{n}] END AS seg FROM t{n - 1}),
            c{n} AS (SELECT host, template, seg, count(*) AS k FROM s{n} WHERE seg IS NOT NULL GROUP BY ALL),
            n{n} AS (SELECT host, template, count(*) AS kids, sum(k) AS total FROM c{n} GROUP BY ALL),
            l{n} AS (SELECT c.* FROM c{n} c JOIN n{n} USING (host, template)
                WHERE NOT (kids >= {min_children} AND total < {rows_per_child} * kids) OR k >= {literal_rows} AND k >= {literal_share} * total),
            t{n} AS (SELECT s.page_id, s.host, s.path, s.parts,
                CASE WHEN s.seg IS NULL THEN s.template WHEN l.seg IS NOT NULL THEN s.template || '/' || s.seg
                ELSE s.template || '/*' || regexp_extract(s.seg, '(\.[A-Za-z][A-Za-z0-9]{{0,4}})$', 1) END AS template
                FROM s{n} s LEFT JOIN l{n} l ON s.host = l.host AND s.template = l.template AND s.seg = l.seg)"""
        shapes += f""", e{n} AS (SELECT *, segs[{n}] AS branch, array_to_string(segs[{n + 1}:], '/') || '|' || len(segs) AS suffix FROM m{n - 1}),
            f{n} AS (SELECT host, shape, branch, suffix, sum(n) AS cn, sum(lab) AS cl, sum(bad) AS cb FROM e{n} WHERE branch IS NOT NULL GROUP BY ALL),
            g{n} AS (SELECT *, sum(cn) OVER (PARTITION BY host, shape, suffix) AS alike FROM f{n}),
            w{n} AS (SELECT host, shape, sum(cn) AS whole, sum(cl) AS known, sum(cb) AS blocked, count(DISTINCT suffix) - 1 AS free FROM f{n} GROUP BY ALL),
            b{n} AS (SELECT host, shape, branch, sum(cn) AS size, sum(cl) AS lab, sum(cb) AS bad, sum(cn * cn / alike) AS square FROM g{n} GROUP BY ALL),
            r{n} AS (SELECT b.host, b.shape, b.branch, size < whole AND square * whole / size - size <= free + {z} * sqrt(2 * free) + 1e-9
                AND (lab = 0 OR abs(bad / greatest(lab, 1) - blocked / greatest(known, 1))
                    <= {z} * sqrt(blocked / greatest(known, 1) * (1 - blocked / greatest(known, 1)) / greatest(lab, 1)) + 1e-9) AS alike FROM b{n} b JOIN w{n} USING (host, shape)),
            m{n} AS (SELECT e.host, e.template, e.segs, e.n, e.lab, e.bad, e.shape || CASE WHEN e.branch IS NULL THEN '' WHEN r.alike THEN '/~' ELSE '/' || e.branch END AS shape
                FROM e{n} e LEFT JOIN r{n} r ON e.host = r.host AND e.shape = r.shape AND e.branch = r.branch)"""
    return rf"""
        WITH parsed AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed
        ), t0 AS (SELECT *, CASE WHEN path = '' THEN [] ELSE string_split(path, '/')[2:] END AS parts, '' AS template FROM split){tree},
        ruled AS (SELECT page_id, host, path, parts, template, {case(1)} AS rule, {case(2)} AS ruled FROM t{levels}),
        m0 AS (
            SELECT host, template, CASE WHEN template = '' THEN [] ELSE string_split(template, '/')[2:] END AS segs, count(*) AS n, count(ruled) AS lab, count(*) FILTER (WHERE ruled = 'block') AS bad, '' AS shape
            FROM ruled GROUP BY host, template
        ){shapes},
        pooled AS (SELECT host, shape, sum(lab) AS plab, sum(bad) AS pbad, sum(lab) / sum(n) AS known FROM m{levels} GROUP BY ALL),
        overall AS (SELECT coalesce(sum(bad) / greatest(sum(lab), 1), 0) AS share FROM m{levels}),
        hosts AS (SELECT host, (sum(bad) + {smoothing} * any_value(share)) / (sum(lab) + {smoothing}) AS prior FROM m{levels}, overall GROUP BY host),
        pure AS (SELECT host, template, shape, known, (pbad + {smoothing} * prior) / (plab + {smoothing}) AS purity FROM m{levels} JOIN pooled USING (host, shape) JOIN hosts USING (host))
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {reject_at} AND known >= {known_from} THEN 'block' ELSE 'allow' END) AS verdict, template, shape, known, purity
        FROM ruled JOIN pure USING (host, template)
    """
