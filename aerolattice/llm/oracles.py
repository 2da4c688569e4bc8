"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .filter_audit import MARKS, MAX_CAPITALS, MIN_DISTINCT
from .filter_audit import MIN_WORDS as AUDIT_WORDS
from .quality_rules import CLASSES, COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_REFERENCE_WORDS, MIN_WORDS, SPACE, SYMBOLS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_rules() -> str:
    """Base counts and verdict of op6: windows are unnested, histograms are lists."""
    rests = "".join(f", r{k + 1} AS (SELECT *, regexp_replace(s{k}, {_quoted(p)}, '', 'g') AS s{k + 1} FROM r{k})" for k, p in enumerate(CLASSES))
    n = len(CLASSES)
    classes = ", ".join(f"length(s{k}) - length(s{k + 1})" for k in range(n))
    words = ", ".join(f"len(list_filter(low, lambda x: x = {_quoted(w)}))" for w in COMMON_WORDS)
    sums = {"classes": n + 1, "common": len(COMMON_WORDS) + 1}
    of_lang = ", ".join(f"[{', '.join(f'sum({c}[{k + 1}]) FILTER (WHERE NOT base_failed)' for k in range(m))}] AS ref_{c}" for c, m in sums.items())

    def shares(c: str) -> str:
        return f"list_transform({c}, lambda x: coalesce(x, 0) / greatest(list_sum({c}), 1))"

    def distance(c: str) -> str:
        p, q = shares(c), shares(f"ref_{c}")
        term = "(CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END) / 2"
        return f"sqrt(greatest(list_sum(list_transform(range(1, len({c}) + 1), lambda i: list_transform([[({p})[i], ({q})[i]]], lambda z: {term})[1])), 0))"

    return f"""
    WITH r0 AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS s0 FROM documents){rests},
    w AS (SELECT *, list_filter(regexp_split_to_array(s0, {_quoted(SPACE)}), lambda x: x <> '') AS ws, list_filter(string_split(s0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM r{n}),
    low AS (SELECT *, list_transform(ws, lambda x: lower(x)) AS low FROM w),
    wins AS (SELECT doc_id, i, ws[i:i + 4] AS win FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
    twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins),
    hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS u(k) WHERE c > 1 GROUP BY doc_id),
    f AS (SELECT low.doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(s0) - length(regexp_replace(s0, {_quoted(SYMBOLS)}, '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, [{classes}, length(s{n})] AS classes, [{words}] AS named FROM low LEFT JOIN hit ON low.doc_id = hit.doc_id),
    g AS (SELECT *, list_append(named, n_words - list_sum(named)) AS common, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
    total AS (SELECT {of_lang} FROM g),
    langs AS (SELECT lang, sum(n_words) FILTER (WHERE NOT base_failed) AS words, {of_lang} FROM g GROUP BY lang),
    refs AS (SELECT lang, ref_classes, ref_common FROM langs WHERE words >= {MIN_REFERENCE_WORDS}),
    j AS (SELECT g.*, coalesce(refs.ref_classes, total.ref_classes) AS ref_classes, coalesce(refs.ref_common, total.ref_common) AS ref_common FROM g LEFT JOIN refs ON g.lang = refs.lang, total),
    d AS (SELECT *, {distance('classes')} AS class_distance, {distance('common')} AS word_distance FROM j)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
      NOT base_failed AND NOT (list_sum(classes) >= {MIN_CHARS} AND class_distance > {MAX_CLASS_DISTANCE} OR n_words >= {MIN_WORDS} AND word_distance > {MAX_WORD_DISTANCE}) AS kept FROM d"""


def filter_audit() -> str:
    """The audit of op13: flags of each document, all orders by a join of five letters, counts by comparing sets of letters."""
    taken = " AND ".join(f"a{i}.f <> a{j}.f" for i in range(5) for j in range(i))
    letters = ", ".join(f"(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) a{k}" for k in range(5))
    order = " || ".join(f"a{k}.f" for k in range(5))
    return f"""
    WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), {_quoted(SPACE)}), lambda x: x <> '') AS ws FROM documents),
    firsts AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
    said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    d AS (SELECT part, CASE WHEN len(ws) < {AUDIT_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, {_quoted(MARKS)}) THEN 'D' ELSE '' END
      || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w JOIN firsts USING (text) LEFT JOIN said ON w.doc_id = said.doc_id),
    c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY part, failed),
    orders AS (SELECT {order} AS filter_order FROM {letters} WHERE {taken}),
    steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k:k] AS f, filter_order[1:k - 1] AS before FROM orders, unnest(range(1, 6)) AS u(k)),
    r AS (SELECT part, filter_order, step, f,
      sum(CASE WHEN translate(failed, before || f, '') = failed THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') <> failed THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, steps GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
      CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
