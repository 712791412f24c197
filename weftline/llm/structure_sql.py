"""DuckDB SQL for conversation repair and URL filters, written another way than the Spark code."""

from __future__ import annotations

# A way is its cost in nine digits, then its audit, so that the least string is the least way.


def _add(way: str, cost: str, letters: str) -> str:
    return f"(lpad(CAST(CAST(substr({way}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{letters}')"


def _keep(way: str, initial: str) -> str:
    return f"CASE WHEN initial = '{initial}' THEN {_add(way, 'extra', 'K')} END"


_DELETED = [_add(s, "2", "D") for s in "esua"]

#: Row by row over each conversation, without stretches; the repaired roles come from the place's parity.
REPAIRED = rf"""WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS tab FROM (
SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(0, 256) r(i))),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS kind FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS initial,
NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut FROM d),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, initial, empty, NOT empty AND seen AS twice, NOT empty AND NOT seen AND cut AS cut, CASE WHEN NOT empty AND NOT seen AND cut THEN 5 ELSE 0 END AS extra,
lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS odd FROM o),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM f
UNION ALL SELECT conv_id, i,
{_DELETED[0]},
CASE WHEN dead THEN {_DELETED[1]} ELSE least({_DELETED[1]}, {_keep("e", "s")}) END,
CASE WHEN dead THEN {_DELETED[2]} ELSE least({_DELETED[2]}, {_keep("ready", "u")}, {_add("ready", "extra + 1", "R")}) END,
CASE WHEN dead THEN {_DELETED[3]} ELSE least({_DELETED[3]}, {_keep("asked", "a")}, {_add("asked", "extra + 1", "R")}) END
FROM (SELECT *, least(e, s, a, {_add("asked", "5", "I")}) AS ready FROM (
SELECT w.*  REPLACE (w.i + 1 AS i), f.initial, f.extra, f.empty OR f.twice AS dead, least(u, {_add("e", "5", "I")}, {_add("s", "5", "I")}, {_add("a", "5", "I")}) AS asked
FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
b AS (SELECT conv_id, least(e, a, {_add("u", "5", "I")}, {_add("s", "10", "II")}) AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
l AS (SELECT conv_id, pos, substr(best, 9 + CAST(pos AS INT), 1) AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS pos FROM b)),
n AS (SELECT conv_id, letter, count(*) FILTER (letter <> 'I') OVER v AS i, count(*) FILTER (letter <> 'D') OVER v AS place FROM l WINDOW v AS (PARTITION BY conv_id ORDER BY pos)),
m AS (SELECT n.conv_id, place, letter, CASE WHEN letter <> 'I' THEN f.role END AS role, CASE WHEN letter <> 'I' THEN f.text ELSE '' END AS text,
max(CASE WHEN place = 1 AND letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS headed
FROM n LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i WHERE letter <> 'D'),
g AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place)) AS digest FROM m GROUP BY 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (empty) AS blank, count(*) FILTER (twice) AS duplicate,
count(*) FILTER (cut) AS truncated, count(*) FILTER (odd) AS illegal FROM f GROUP BY 1)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
coalesce(CAST(substr(best, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM x.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id"""


def filtered(rules: list[tuple[str, str, str]], depth: int, least_rows: int, most_branches: int, smoothing: float, deviate: float, reject: float) -> str:
    """Verdicts of all pages; ``rules`` as (host, path, verdict)."""
    sql = [
        r"""WITH pg AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
lb AS (SELECT CAST(doc_id AS BIGINT) AS doc, max(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
pt AS (SELECT host, path, CASE WHEN path LIKE '/%' THEN string_split(substr(path, 2), '/') ELSE [] END AS segs, count(*) AS n, count(bad) AS labelled, count(*) FILTER (bad) AS bad
FROM pg LEFT JOIN lb ON lb.doc = TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(\.[a-z]+)?/?$', 1) AS BIGINT) GROUP BY 1, 2),
t0 AS (SELECT *, '' AS template FROM pt)"""
    ]
    for d in range(depth):
        sql.append(
            f"""k{d} AS (SELECT host, template, segs[{d + 1}] AS seg, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad, sum(sum(n)) OVER v AS all_n, sum(sum(labelled)) OVER v AS all_l, sum(sum(bad)) OVER v AS all_b
FROM t{d} WHERE len(segs) > {d} GROUP BY 1, 2, 3 WINDOW v AS (PARTITION BY host, template)),
s{d} AS (SELECT *, (bad + {smoothing} * CASE WHEN all_l > 0 THEN all_b / all_l ELSE 0 END) / (labelled + {smoothing}) AS share FROM k{d} WHERE n >= {least_rows} AND n * {most_branches} >= all_n),
q{d} AS (SELECT *, lag(bad) OVER v AS pb, lag(labelled) OVER v AS pl FROM s{d} WINDOW v AS (PARTITION BY host, template ORDER BY share, seg)),
g{d} AS (SELECT *, sum(CASE WHEN pl > 0 AND labelled > 0 AND (bad / labelled - pb / pl) * (bad / labelled - pb / pl) >
{deviate * deviate!r} * ((bad + pb) / (labelled + pl) * (1 - (bad + pb) / (labelled + pl)) * (1 / CAST(labelled AS DOUBLE) + 1 / CAST(pl AS DOUBLE))) THEN 1 ELSE 0 END)
OVER (PARTITION BY host, template ORDER BY share, seg) AS grp FROM q{d}),
b{d} AS (SELECT host, template, seg, CASE WHEN count(*) OVER v > 1 THEN '{{' || array_to_string(list_sort(list(seg) OVER v), '|') || '}}' ELSE seg END AS branch FROM g{d} WINDOW v AS (PARTITION BY host, template, grp)),
t{d + 1} AS (SELECT t.* REPLACE (CASE WHEN len(segs) > {d} THEN t.template || '/' || coalesce(branch, '*' || regexp_extract(segs[{d + 1}], '(\\.[A-Za-z]{{1,5}})$', 1)) ELSE t.template END AS template)
FROM t{d} t LEFT JOIN b{d} b ON b.host = t.host AND b.template = t.template AND b.seg = t.segs[{d + 1}])"""
        )
    cases = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{}}".format(f"'{h + p}'") for h, p, _ in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    )
    verdicts = " ".join(f"WHEN '{h + p}' THEN '{v}'" for h, p, v in rules)
    sql.append(
        f"""e AS (SELECT * REPLACE (template || CASE WHEN len(segs) > {depth} THEN '/**' ELSE '' END AS template) FROM t{depth}),
z AS (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad FROM e GROUP BY 1, 2),
a AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS base FROM z),
hs AS (SELECT host, (sum(bad) + {smoothing} * any_value(base)) / (sum(labelled) + {smoothing}) AS wider FROM z, a GROUP BY 1),
x AS (SELECT host, template, labelled > 0 AND (bad + {smoothing} * wider) / (labelled + {smoothing}) >= {reject} AS rejected FROM z JOIN hs USING (host)),
r AS (SELECT page_id, host, path, CASE {cases} END AS rule FROM pg)
SELECT page_id, r.host, r.path, e.template, rule, CASE rule {verdicts} ELSE CASE WHEN rejected THEN 'block' ELSE 'allow' END END AS verdict
FROM r JOIN e ON e.host = r.host AND e.path = r.path JOIN x ON x.host = e.host AND x.template = e.template"""
    )
    return ",\n".join(sql)
