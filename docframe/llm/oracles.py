"""DuckDB SQL for the corpus operators that SQL can express on whole tables."""

from __future__ import annotations

from docframe.llm import decontamination as dc
from docframe.llm import url_filter as uf

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
TERMS = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
TEXT = "coalesce(text, '')"
LOWER = f"translate({TEXT}, '{UPPER}', '{UPPER.lower()}')"

OP2 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {WORDS.format(TEXT)} AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, unnest(range(1, len(w) - 48)) u(i)),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, j FROM win JOIN least USING (s), unnest(range(i, i + 50)) u(j) WHERE first < doc_id),
word AS (SELECT rid, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) u(j)),
kept AS (SELECT word.rid, string_agg(x, ' ' ORDER BY word.j) AS s FROM word ANTI JOIN gone ON word.rid = gone.rid AND word.j = gone.j GROUP BY word.rid),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)"""

OP3 = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, {TERMS.format(LOWER)} AS w FROM documents),
b AS (SELECT item_id, {TERMS.format(LOWER)} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g, len(w[i:i + 7]) AS n FROM b, unnest(range(1, greatest(1, len(w) - 7) + 1)) u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win), phrases AS (SELECT DISTINCT g, n FROM win),
pos AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT * FROM t, sizes), unnest(range(1, len(w) - n + 2)) u(i)),
met AS (SELECT rid, i, n, g FROM pos JOIN phrases USING (g, n)),
hit AS (SELECT rid, count(DISTINCT j) AS n FROM met, unnest(range(i, i + n)) u(j) GROUP BY rid),
item AS (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM met JOIN win USING (g, n)),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM item GROUP BY rid),
bt AS (SELECT DISTINCT item_id, unnest(w) AS term FROM b),
need AS (SELECT item_id, count(*) AS k FROM bt GROUP BY item_id),
place AS (SELECT rid, item_id, j, term FROM (SELECT rid, j, w[j] AS term FROM t, unnest(range(1, len(w) + 1)) u(j)) JOIN bt USING (term)),
full_set AS (SELECT rid, item_id, k FROM place JOIN need USING (item_id) GROUP BY rid, item_id, k HAVING count(DISTINCT term) = k),
held AS (SELECT rid, item_id, j, term, k FROM place JOIN full_set USING (rid, item_id)),
near AS (SELECT DISTINCT x.rid, x.item_id FROM held x JOIN held y ON x.rid = y.rid AND x.item_id = y.item_id AND y.j BETWEEN x.j AND x.j + {dc.WIDTH - 1} GROUP BY x.rid, x.item_id, x.j, x.k HAVING count(DISTINCT y.term) = x.k),
nears AS (SELECT rid, count(*) AS n FROM near GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
 coalesce(items.n, 0) >= 2 AS contaminated, coalesce(nears.n, 0)::BIGINT AS n_near FROM t LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN nears USING (rid)"""

OP8 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(source, '') AS host, source IS NULL AS nohost, {TEXT} AS x, {WORDS.format(TEXT)} AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) u(i)),
twice AS (SELECT rid, s FROM win GROUP BY rid, s HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM win JOIN twice USING (rid, s), unnest(range(i, i + 8)) u(j) GROUP BY rid),
line AS (SELECT rid, unnest(string_split(x, chr(10))) AS l FROM d),
lines AS (SELECT rid, count(*) AS n, count(DISTINCT l) AS k FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (SELECT doc_id, host, nohost, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 coalesce(lines.n - lines.k, 0)::BIGINT AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 20 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS failed FROM m),
h AS (SELECT host, nohost, count(*)::BIGINT AS n, count(*) FILTER (failed)::BIGINT AS bad FROM j GROUP BY host, nohost),
a AS (SELECT sum(n)::DOUBLE AS docs, sum(bad) / sum(n) AS mean, count(*) AS k, sum(n * (bad / n) * (bad / n)) AS sq, sum(n::DOUBLE * n) AS nn FROM h),
v AS (SELECT mean, greatest(0, (sq - docs * mean * mean - (k - 1) * mean * (1 - mean)) / nullif(docs - nn / docs, 0)) AS between_hosts FROM a),
p AS (SELECT mean, CASE WHEN between_hosts > 0 AND mean > 0 AND mean < 1 THEN least(1e6, greatest(1, mean * (1 - mean) / between_hosts - 1)) ELSE 1e6 END AS strength FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (bad + mean * strength) / (n + strength) <= 0.5 AS kept,
 n AS host_docs, bad AS host_failures FROM j JOIN h USING (host, nohost), p"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, len(w) < 5 AS short, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.short = b.short AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""


def op4() -> str:
    """Rules and both propagations, a pair of expressions a round."""
    ranked = sorted(uf.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in ranked]
    name = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    lower = lambda x: f"translate({x}, '{UPPER}', '{UPPER.lower()}')"
    link = r"""(?i)href\s*=\s*["'']?[a-z][a-z0-9+.-]*://([^/?#"''\s>]+)"""
    parts = [
        "rest AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages)",
        f"page AS (SELECT page_id, html, coalesce({lower("regexp_extract(r, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM rest)",
        f"ruled AS (SELECT page_id, host, path, {name} AS rule, {verdict} AS ruled FROM page)",
        "seed AS (SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM ruled WHERE host <> '' GROUP BY host)",
        f"link AS (SELECT host AS src, {lower('x')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS x FROM page WHERE host <> ''))",
        "parent AS (SELECT DISTINCT host AS src, regexp_replace(host, '^[^.]*\\.', '') AS dst FROM page WHERE host <> '')",
        "edge AS (SELECT src, dst, count(*) AS n FROM (SELECT * FROM link WHERE src <> dst UNION ALL SELECT * FROM parent WHERE src <> dst AND contains(dst, '.')) GROUP BY src, dst)",
        "node AS (SELECT host FROM seed UNION SELECT src FROM edge UNION SELECT dst FROM edge)",
    ]
    for tag, column, src, dst in (("t", "good", "src", "dst"), ("u", "bad", "dst", "src")):
        parts += [
            f"{tag}w AS (SELECT node.host, coalesce({column}, 0)::DOUBLE / greatest(1, (SELECT sum({column}) FROM seed)) AS w FROM node LEFT JOIN seed USING (host))",
            f"{tag}s AS (SELECT {src} AS a, {dst} AS b, n::DOUBLE / sum(n) OVER (PARTITION BY {src}) AS share FROM edge)",
            f"{tag}0 AS (SELECT host, w AS score FROM {tag}w)",
        ]
        for i in range(uf.ROUNDS):
            parts.append(f"{tag}{i + 1} AS (SELECT w.host, {1 - uf.DAMPING!r} * w.w + {uf.DAMPING!r} * coalesce(g.got, 0) AS score FROM {tag}w w LEFT JOIN (SELECT b, sum(share * score) AS got FROM {tag}s JOIN {tag}{i} ON a = host GROUP BY b) g ON g.b = w.host)")
    last = uf.ROUNDS
    parts.append(f"bad AS (SELECT t.host FROM t{last} t JOIN u{last} u USING (host) WHERE u.score > {uf.RATIO} * t.score + {uf.FLOOR} / greatest(1, (SELECT count(*) FROM node)))")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"


ORACLES = {"op2_super_kmer_dedup": OP2, "op3_positional_index": OP3, "op4_host_trust": op4(), "op8_host_quality": OP8, "op10_count_vector_rtree": OP10}
