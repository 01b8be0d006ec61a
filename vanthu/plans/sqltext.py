"""SQL fragments shared by the statements that give the same rows as the queries."""

from __future__ import annotations

from vanthu.functions import dims, text as T


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(c: str) -> str:
    low = f"translate(lower(coalesce({c}, '')), {quote(T.FOLD_FROM)}, {quote(T.FOLD_TO)})"
    return f"' ' || regexp_replace(regexp_replace({low}, '[\\x{{300}}-\\x{{331}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+', ' ', 'g') || ' '"


def case(values: dict, key: str, default: str) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v) if isinstance(v, str) else v}" for k, v in values.items())
    return f"(CASE {key} {arms} ELSE {default} END)"


def rank(key: str, default: int) -> str:
    return case({c: r for c, r, _ in dims.HIERARCHY}, key, str(default))


def factor(key: str) -> str:
    return case(dims.STATUS_FACTOR, key, "1.0::DOUBLE")


def bm25(table: str, id_col: str, columns: list[str], query: str, name: str = "hits") -> str:
    """Common table expressions that end in ``name`` (id, score)."""
    ps = T.query_phrases(query)
    norm = ", ".join(f"{fold(c)} AS {c}" for c in columns)
    count = lambda c, p: f"(length({c}) - length(replace({c}, {quote(' ' + p)}, ''))) // {len(p) + 1}"
    d = " + ".join(f"len(list_filter(string_split({c}, ' '), lambda w: w <> ''))" for c in columns)
    fs = ", ".join(f"{' + '.join(count(c, p) for c in columns)} AS f{i}" for i, p in enumerate(ps))
    st = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS c{i}" for i in range(len(ps)))
    score = " ".join(f"- greatest(1e-6, ln((nn - c{i} + 0.5) / (c{i} + 0.5))) * (f{i} * 2.2::DOUBLE) / (f{i} + 1.2::DOUBLE * (0.25 + 0.75 * dlen / av))" for i in range(len(ps)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(ps)))
    return (
        f"{name}_n AS (SELECT {id_col} AS id, {norm} FROM {table}), {name}_f AS (SELECT id, {d} AS dlen, {fs} FROM {name}_n), "
        f"{name}_s AS (SELECT count(*)::DOUBLE AS nn, avg(dlen) AS av, {st} FROM {name}_f), {name} AS (SELECT id, 0.0::DOUBLE {score} AS score FROM {name}_f, {name}_s WHERE {every})"
    )


DOT = "list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
RECENCY = (
    "coalesce(1.0 + greatest(0.0, (try_cast(CASE WHEN regexp_full_match({y}, '\\s*\\d{{1,6}}\\s*') THEN trim({y}) END AS INTEGER) - 2000) / 100.0), 1.0)"
)


def recency(c: str) -> str:
    y = f"(CASE WHEN contains(coalesce({c}, ''), '/') THEN string_split({c}, '/')[-1] ELSE substring(coalesce({c}, ''), 1, 4) END)"
    return RECENCY.format(y=y)
