"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from meterframe.llm.license_scan import LEAST_SHARE, TEMPLATES
from meterframe.llm.pipeline_stages import LEVELS, WEIGHTS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
            FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
       FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, r.n FROM runs r JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w
                      FROM documents),
sh AS (SELECT DISTINCT doc_id, least(len(w), 4) AS n, array_to_string(w[i:i + 3], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS m FROM sh GROUP BY 1),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.n = b.n AND a.doc_id <> b.doc_id
         GROUP BY 1, 2),
links AS (SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.m + y.m - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(m, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id ON least_id.a = d.doc_id"""


def _mixing(share: str, epochs: int, seed: int) -> str:
    names = [", ".join(LEVELS[:k]) for k in range(1, len(LEVELS) + 1)]
    ctes = [f"""docs AS (SELECT doc_id, coalesce('domain' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4), 'other') AS domain,
      coalesce(lang, '<null>') AS lang, coalesce(source, '<null>') AS source, lang AS own_lang, source AS own_source,
      len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n_tokens FROM documents)""",
            f"leaves AS (SELECT {names[-1]}, sum(n_tokens) AS tokens, sum(n_tokens) * {epochs} AS cap FROM docs GROUP BY ALL)",
            f"b0 AS (SELECT 1 AS root, CAST(floor(sum(tokens) * {share}) AS HUGEINT) AS budget FROM leaves)"]
    for k in range(1, len(LEVELS) + 1):
        above = ", ".join(["root", *LEVELS[:k - 1]])
        case = " ".join(f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(LEVELS, path))} THEN {w}"
                        for path, w in WEIGHTS.items() if len(path) == k)
        fill = f"PARTITION BY {above} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {LEVELS[k - 1]}"
        upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        ctes += [
            f"n{k} AS (SELECT 1 AS root, {names[k - 1]}, sum(cap) AS cap, {f'CASE {case} ELSE 1 END' if case else '1'} AS weight FROM leaves GROUP BY ALL)",
            f"""f{k} AS (SELECT *, cap * sum(weight) OVER ({fill} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <=
                weight * (budget - coalesce(sum(cap) OVER ({fill} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS up
                FROM n{k} JOIN b{k - 1} USING ({above}) WHERE weight > 0)""",
            f"g{k} AS (SELECT *, bool_and(up) OVER ({fill} {upto}) AS done FROM f{k})",
            f"""h{k} AS (SELECT *, budget - sum(CASE WHEN done THEN cap ELSE 0 END) OVER (PARTITION BY {above}) AS pool,
                CASE WHEN done THEN 0 ELSE weight END AS open, sum(CASE WHEN done THEN 0 ELSE weight END) OVER (PARTITION BY {above}) AS opens,
                sum(CASE WHEN done THEN 0 ELSE weight END) OVER (PARTITION BY {above} ORDER BY {LEVELS[k - 1]} {upto}) AS w FROM g{k})""",
            f"""b{k} AS (SELECT root, {names[k - 1]}, CASE WHEN done THEN cap ELSE
                CAST(pool * w AS HUGEINT) // CAST(opens AS HUGEINT) - CAST(pool * (w - open) AS HUGEINT) // CAST(opens AS HUGEINT) END AS budget FROM h{k})"""]
    leaf = names[-1]
    ctes += [
        f"""plan AS (SELECT {leaf}, tokens, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
            budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM leaves JOIN b{len(LEVELS)} USING ({leaf}))""",
        f"rows AS (SELECT *, unnest(range(0, CAST(epochs AS BIGINT) + 1)) AS epoch FROM docs JOIN plan USING ({leaf}))",
        f"""ranked AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {leaf}, epoch ORDER BY
            md5('{seed}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM rows)"""]
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, domain, own_lang AS lang, own_source AS source, CAST(epoch AS INT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(CASE WHEN epoch < epochs THEN n_tokens ELSE least(n_tokens, rest - ahead) END AS BIGINT) AS take_tokens
FROM ranked WHERE epoch < epochs OR (ahead < rest)"""


MIXING = _mixing("0.5", 2, 17)


def _template_rows() -> str:
    return ", ".join(f"({n}, '{t.label}', {t.base}, {i}, '{w}', {t.key[0] <= i < t.key[1]})"
                     for n, t in enumerate(TEMPLATES) for i, w in enumerate(t.words))


LICENSES = f"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
            FROM documents),
tw(template, label, base, off, word, in_key) AS (VALUES {_template_rows()}),
hits AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM dw),
near AS (SELECT * FROM hits WHERE word IN (SELECT word FROM tw)),
held AS (SELECT word, count(DISTINCT doc_id) AS n FROM near GROUP BY 1),
weights AS (SELECT word, CAST(floor(log10((SELECT count(*) + 1 FROM dw) / (coalesce(n, 0) + 1)) * 1000 + 0.5) AS BIGINT) + 1 AS weight
            FROM (SELECT DISTINCT word FROM tw) LEFT JOIN held USING (word)),
t AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY weight DESC, off) = 1 AS anchor FROM tw JOIN weights USING (word)),
heads AS (SELECT template, sum(weight) AS total, count(*) FILTER (WHERE in_key) AS n_key FROM t GROUP BY 1),
met AS (SELECT doc_id, template, label, base, pos - off AS start, sum(weight) AS got, count(*) FILTER (WHERE in_key) AS k,
          bool_or(anchor) AS anchored FROM near JOIN t USING (word) GROUP BY 1, 2, 3, 4, 5),
found AS (SELECT *, CAST(got AS DOUBLE) / CAST(total AS DOUBLE) AS share,
            k = n_key AND CAST(got AS DOUBLE) / CAST(total AS DOUBLE) >= {LEAST_SHARE} AS ok
          FROM met JOIN heads USING (template) WHERE anchored),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE base AND ok) AS n_base, min(start) FILTER (WHERE base AND ok) AS first_word,
    max(start) FILTER (WHERE base AND ok) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND ok) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE ok) AS labels, max(CASE WHEN ok THEN share ELSE share / 2 END) AS score
  FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0) AS score
FROM dw LEFT JOIN by_doc USING (doc_id)"""
