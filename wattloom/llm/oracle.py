"""DuckDB SQL for the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

import re

from wattloom.llm.secret_scan import BASE, RULES, Rule


def _pattern(rule: Rule) -> str:
    """The rule's pattern for a matcher whose own case folding isn't ASCII: letters outside of classes and
    escapes are spelled in both cases."""
    if not rule.fold:
        return rule.pattern
    parts = re.split(r"(\[[^\]]*\]|\\x[0-9A-Fa-f]{2}|\\.)", rule.pattern)
    return "".join(p if k % 2 else re.sub("[A-Za-z]", lambda m: f"[{m[0].lower()}{m[0].upper()}]", p) for k, p in enumerate(parts))


def secrets_sql() -> str:
    """Every rule scans every text: no index."""
    q = {k: _pattern(r).replace("'", "''") for k, r in enumerate(RULES)}
    found = ", ".join(f"regexp_split_to_array(t, '{q[k]}') AS s{k}, regexp_extract_all(t, '{q[k]}', 0) AS m{k}, regexp_extract_all(t, '{q[k]}', {r.group}) AS g{k}" for k, r in enumerate(RULES))
    size = lambda a: f"COALESCE(list_sum(list_transform({a}, lambda x: length(x))), 0)"
    spans = [
        f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'start': CAST({size(f's{k}[1:i]')} + {size(f'm{k}[1:i-1]')} AS BIGINT), 'ord': {k}, 'stop': CAST({size(f's{k}[1:i]')} + {size(f'm{k}[1:i]')} AS BIGINT), 'kind': '{r.kind}', 'n': length(g{k}[i])}}), lambda x: x.n >= {r.least})"
        for k, r in enumerate(RULES)
    ]
    both = spans[0]
    for s in spans[1:]:
        both = f"list_concat({both}, {s})"
    text = lambda a: f"array_to_string(list_transform({a}, lambda x: x.kind || ':' || x.start || ':' || x.stop), ',')"
    counts = ", ".join(f"CAST(len(list_filter(spans, lambda x: x.ord = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(BASE))
    return (
        f"WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), m AS (SELECT doc_id, {found} FROM d), p AS (SELECT doc_id, list_sort({both}) AS spans FROM m) "
        f"SELECT doc_id, {counts}, sha256({text(f'list_filter(spans, lambda x: x.ord < {len(BASE)})')}) AS base_sha256, {text('spans')} AS spans FROM p"
    )


#: All pairs of vectors, and who is reachable from whom: for small tables.
EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT l.a, r.other FROM r JOIN l ON r.vec_id = l.b)
SELECT vec_id, (SELECT COUNT(*) FROM l WHERE l.a = r.vec_id) AS n_links, MIN(other) AS component_id, vec_id = MIN(other) AS kept FROM r GROUP BY vec_id"""

#: Every phrase of 13 words as text, and where it first starts.
REPEATS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
p AS (SELECT doc_id, UNNEST(range(1, len(a) - 11)) AS i, UNNEST(list_transform(range(1, len(a) - 11), lambda k: array_to_string(a[k:k+12], ' '))) AS phrase FROM w WHERE len(a) >= 13),
f AS (SELECT phrase, MIN(doc_id) AS first FROM p GROUP BY phrase),
r AS (SELECT p.doc_id, p.i FROM p JOIN f ON f.phrase = p.phrase WHERE f.first < p.doc_id),
x AS (SELECT doc_id, UNNEST(range(1, len(a) + 1)) AS i, UNNEST(a) AS word FROM w),
y AS (SELECT x.doc_id, x.i, word, MAX(CASE WHEN r.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.i = x.i)
SELECT w.doc_id, CAST(COUNT(y.i) AS BIGINT) AS n_words, CAST(COALESCE(SUM(gone), 0) AS BIGINT) AS n_removed, sha256(COALESCE(string_agg(word, ' ' ORDER BY y.i) FILTER (WHERE gone = 0), '')) AS kept_sha256 FROM w LEFT JOIN y ON y.doc_id = w.doc_id GROUP BY w.doc_id"""


def codes_sql(rounds: int = 4) -> str:
    """Every part against every entry, round by round."""
    assign = "SELECT q.vec_id, q.part, MIN(CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS HUGEINT) * 256 + entry) AS m FROM q JOIN b{k} b ON b.part = q.part GROUP BY 1, 2"
    means = "SELECT part, entry, list(c ORDER BY i) AS c FROM (SELECT part, entry, i, CAST(floor(CAST(SUM(v) AS DOUBLE) / COUNT(*)) AS BIGINT) AS c FROM (SELECT q.part, CAST(m % 256 AS BIGINT) AS entry, UNNEST(range(1, len(x) + 1)) AS i, UNNEST(x) AS v FROM q JOIN a{k} a ON a.vec_id = q.vec_id AND a.part = q.part) GROUP BY 1, 2, 3) GROUP BY 1, 2"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        "q AS MATERIALIZED (SELECT vec_id, label, k AS part, e[k * (len(e) // 4) + 1:(k + 1) * (len(e) // 4)] AS x FROM v, (SELECT UNNEST(range(0, 4)) AS k))",
        "b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x AS c FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY part ORDER BY vec_id) AS n FROM q) WHERE n <= 256)",
    ]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({assign.format(k=k)})")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, COALESCE(u.c, b.c) AS c FROM b{k} b LEFT JOIN ({means.format(k=k)}) u ON u.part = b.part AND u.entry = b.entry)")
    steps.append(f"a{rounds} AS MATERIALIZED ({assign.format(k=rounds)})")
    steps.append(f"r AS (SELECT v.vec_id, v.label, string_agg(printf('%02x', CAST(m % 256 AS BIGINT)), '' ORDER BY part) AS code, CAST(SUM(m // 256) AS BIGINT) AS error FROM v JOIN a{rounds} a ON a.vec_id = v.vec_id GROUP BY 1, 2)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM r"


SQL = {"op1_secret_scans": secrets_sql(), "op10_embedding_near_dedup": EMBEDDINGS, "op11_substring_dedup": REPEATS, "op12_vector_codes": codes_sql()}
