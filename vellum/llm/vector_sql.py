"""SQL of the vector operators; all arithmetic is on whole numbers."""

from __future__ import annotations


def finite(dimension: int | None) -> str:
    length = "len(embedding) > 0" if dimension is None else f"len(embedding) = {dimension}"
    return f"{length} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"


def floored(total: str, count: str) -> str:
    """Floor of a quotient of whole numbers."""
    return f"(({total} - (({total} % {count}) + {count}) % {count}) // {count})::BIGINT"


def cluster_sql(clusters: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64) -> str:
    gap = "list_sum(list_transform(list_zip(p, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"a{n} AS (SELECT vec_id, p, min({{'d': {gap}, 'c': c}}) AS best FROM kept CROSS JOIN m{n} GROUP BY vec_id, p)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT best.c AS c, i, sum(p[i]) AS total, count(*)::HUGEINT AS n FROM a{n} CROSS JOIN (SELECT unnest(range(1, {dimension + 1})) AS i) GROUP BY ALL)")
            steps.append(f"m{n + 1} AS (SELECT m.c, coalesce(new.m, m.m) AS m FROM m{n} m LEFT JOIN (SELECT c, list({floored('total', 'n')} ORDER BY i) AS m FROM s{n} GROUP BY c) new USING (c))")
    return f"""
    WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS p FROM embeddings WHERE {finite(dimension)}),
    m0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, p AS m FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {clusters}),
    {", ".join(steps)}
    SELECT vec_id, best.c::INTEGER AS "cluster", best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(m, ',')) AS centroid_sha256
    FROM a{rounds} JOIN m{rounds} f ON f.c = best.c
    """


def code_sql(parts: int = 16, entries: int = 64, rounds: int = 2, dimension: int = 64, scale: int = 256) -> str:
    width = dimension // parts
    gap = " + ".join(f"(q[{i}] - m[{i}]) * (q[{i}] - m[{i}])" for i in range(1, width + 1))
    steps = []
    for n in range(rounds + 1):
        steps.append(f"a{n} AS (SELECT vec_id, part, q, min({{'d': {gap}, 'e': e}}) AS best FROM cuts JOIN m{n} USING (part) GROUP BY vec_id, part, q)")
        if n < rounds:
            means = ", ".join(floored(f"sum(q[{i}])", "count(*)::HUGEINT") for i in range(1, width + 1))
            steps.append(f"m{n + 1} AS (SELECT m.part, m.e, coalesce(new.m, m.m) AS m FROM m{n} m LEFT JOIN (SELECT part, best.e AS e, [{means}] AS m FROM a{n} GROUP BY part, best.e) new USING (part, e))")
    return f"""
    WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS p FROM embeddings WHERE {finite(None)}),
    cuts AS (SELECT vec_id, part, p[part * {width} + 1 : part * {width} + {width}] AS q FROM kept CROSS JOIN (SELECT unnest(range({parts})) AS part)),
    m0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, q AS m FROM cuts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
    {", ".join(steps)},
    books AS (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY part, e)) AS digest FROM m{rounds}),
    coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
    SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded c JOIN kept USING (vec_id) CROSS JOIN books
    """
