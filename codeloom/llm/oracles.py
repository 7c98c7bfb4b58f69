"""The same results as DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from codeloom.llm.licenses import K, PHRASES, TEMPLATES
from codeloom.llm.quality import RULES, STOP_WORDS

_SPLIT = r"[\x20\x09-\x0D]+"


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _broken() -> str:
    """Names of the rules a text breaks, comma-joined, in the table's order."""
    cases = []
    for rule in RULES:
        bounds = [f"{rule.ratio} < {rule.low!r}"] if rule.low is not None else []
        bounds += [f"{rule.ratio} > {rule.high!r}"] if rule.high is not None else []
        test = f"({' OR '.join(bounds)})"
        if rule.langs is not None:
            test += f" AND coalesce(list_contains({_listed([*rule.langs])}, lang), false)"
        if rule.min_words:
            test += f" AND n_words >= {rule.min_words}"
        cases.append(f"CASE WHEN {test} THEN '{rule.ratio}' END")
    return f"concat_ws(',', {', '.join(cases)})"


def _stop_words() -> str:
    cases = "".join(
        f" WHEN '{lang}' THEN len(list_filter(words, lambda x: list_contains({_listed(listed.split())}, x)))"
        for lang, listed in STOP_WORDS.items()
    )
    return f"CASE lang{cases} ELSE 0 END"


QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT *, list_filter(string_split_regex(text, '{_SPLIT}'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM cut WHERE len(words) > 5)
), repeated AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), steps AS (
  SELECT r, least(coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5), 5) AS step FROM repeated
), covered AS (SELECT r, sum(step) AS n FROM steps GROUP BY r), counts AS (
  SELECT doc_id, lang, len(words) AS n_words,
    length(regexp_replace(text, '{_SPLIT}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, {_stop_words()} AS n_stop_words,
    len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullet_lines
  FROM cut LEFT JOIN covered USING (r)
), ratios AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_length,
    n_symbols / greatest(n_words, 1) AS symbols_per_word,
    n_stop_words / greatest(n_words, 1) AS stop_word_share,
    n_dup_lines / greatest(n_lines, 1) AS duplicate_line_share,
    n_ellipsis_lines / greatest(n_lines, 1) AS ellipsis_line_share,
    n_bullet_lines / greatest(n_lines, 1) AS bullet_line_share,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM counts
)
SELECT * EXCLUDE (lang), {_broken()} AS broken, NOT base_failed AND broken = '' AS kept FROM ratios
"""

_WORDS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex({text}, '{split}'), lambda x: x <> '') AS words
  FROM documents
)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licenses() -> str:
    phrases = ", ".join(f"('{label}', '{phrase}')" for label, phrase in PHRASES.items())
    templates = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    words = _WORDS.format(text=_LOWER, split=r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return rf"""{words}, phrases AS (
  SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {phrases}) AS t(label, phrase)
), templates AS (
  SELECT template, label, string_split(text, ' ') AS tw, len(tw) - {K - 1} AS n_grams
  FROM (VALUES {templates}) AS t(template, label, text)
), template_grams AS (
  SELECT template, label, n_grams, tpos, tw[tpos + 1:tpos + {K}] AS gram
  FROM (SELECT *, unnest(range(0, n_grams)) AS tpos FROM templates)
), places AS (SELECT r, words, unnest(range(0, len(words))) AS pos FROM d), base AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
    list_sort(list(DISTINCT label)) AS base
  FROM places JOIN phrases ON words[pos + 1] = p[1] AND words[pos + 1:pos + len(p)] = p GROUP BY r
), hits AS (
  SELECT r, label, template, n_grams, pos, tpos, pos - tpos AS diagonal
  FROM (SELECT r, pos, words[pos + 1:pos + {K}] AS gram FROM places) JOIN template_grams USING (gram)
), steps AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal, pos) AS step FROM hits
), runs AS (
  SELECT *, sum(CASE WHEN step <= 3 THEN 0 ELSE 1 END)
    OVER (PARTITION BY r, template ORDER BY diagonal, pos, tpos) AS run
  FROM steps
), spans AS (
  SELECT r, label, count(DISTINCT tpos) / any_value(n_grams) AS score
  FROM runs GROUP BY r, label, template, run
), verdict AS (
  SELECT r, list(DISTINCT label) FILTER (score >= 0.6) AS found, max(score) AS score FROM spans GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
  coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN verdict USING (r)
"""


NEAR_DUPLICATES = rf"""
WITH RECURSIVE {_WORDS.format(text=_LOWER, split=_SPLIT).strip().removeprefix("WITH ")}, sets AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(words) >= 4
    THEN list_transform(range(1, len(words) - 2), lambda i: words[i:i + 3])
    WHEN len(words) > 0 THEN [words] ELSE [] END) AS s
  FROM d
), same AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY 1, 3),
entries AS (SELECT rep, n, unnest(s) AS v FROM same), links AS (
  SELECT a.rep AS a, b.rep AS b FROM entries a JOIN entries b ON a.v = b.v AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (
  SELECT rep AS node, rep AS root FROM same
  UNION SELECT b, root FROM reach JOIN both_ways ON node = a AND root < b
), roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node), members AS (
  SELECT doc_id, s, len(s) AS n, list_sort(s) AS k FROM sets
)
SELECT doc_id, m.n AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(root, doc_id) END AS component_id,
  coalesce(doc_id = component_id, true) AS kept
FROM members m LEFT JOIN same ON same.s = k LEFT JOIN roots ON node = rep
"""

SOURCE_AUDIT = r"""
WITH given AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM given
), terms AS (
  SELECT row, lang, source,
         translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words
), kept AS (
  SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), langs AS (
  SELECT lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n
  FROM (SELECT DISTINCT lang FROM given) LEFT JOIN kept k USING (lang) GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM given) LEFT JOIN counts c USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (t.n + 5 * l.v) AS p,
         1 + (1000000000 * (k.n + 5)::HUGEINT) // (l.n + 5 * l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM parts
)
SELECT lang, source, part, item, value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= 50
"""

ORACLES: dict[str, str] = {
    "op5_quality_rules": QUALITY,
    "op7_license_scan": _licenses(),
    "op11_source_audit": SOURCE_AUDIT,
    "op9_near_duplicates": NEAR_DUPLICATES,
}
