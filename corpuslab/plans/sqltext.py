"""Pieces of the comparison SQL that several queries share."""

from __future__ import annotations

from ..functions.fixed import CHAT_ARTIFACTS, FLAG_PENALTIES, HARD_FLAGS, LEAKAGE_WORDS, PUNCTUATION, QUECHUA_ENDINGS, QUECHUA_SIGNAL, SENTENCE_ENDS, SPACE, SPANISH_SIGNAL

PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS source, b.text AS target FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""
POOL = """pool AS (SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS candidate_index, c.text AS prediction,
  first_value(c.text) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS source, last_value(c.text) OVER (PARTITION BY c.conv_id ORDER BY c.turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS reference FROM conversations c)"""


def listing(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}+', ' ', 'g'))"


def pair_norm(c: str) -> str:
    return f"regexp_replace(regexp_replace({norm(c)}, '{SPACE}+([,.;:?!])', '\\1', 'g'), '([¿¡]){SPACE}+', '\\1', 'g')"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({norm(c)}), '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+')"


def words(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_-]+'), lambda x: lower(x))"


def share(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) * 1.0 / greatest(len(list_distinct({a})), len(list_distinct({b}))) END)"


def n_words(c: str) -> str:
    return f"(CASE WHEN {norm(c)} = '' THEN 0 ELSE len(string_split({norm(c)}, ' ')) END)"


def copied(h: str, s: str) -> str:
    own = f"list_filter({h}, lambda x: NOT list_contains({listing(LEAKAGE_WORDS)}, x))"
    src = f"list_filter({s}, lambda x: NOT list_contains({listing(LEAKAGE_WORDS)}, x))"
    return f"(CASE WHEN len({own}) = 0 OR len({src}) = 0 THEN 0.0 ELSE len(list_filter({own}, lambda y: list_contains({src}, y))) * 1.0 / len({own}) END)"


def leak(t: str) -> str:
    return f"least(0.25, len(list_filter({t}, lambda x: list_contains({listing(LEAKAGE_WORDS)}, x))) * 1.0 / greatest(4, len({t})))"


def artifacts(c: str) -> str:
    padded = f"(' ' || lower({norm(c)}) || ' ')"
    hits = " + ".join(f"(length({padded}) - length(replace({padded}, '{a}', ''))) / {len(a)}" for a in CHAT_ARTIFACTS)
    return f"least(0.6, 0.18 * ({hits}))"


def repeated(t: str) -> str:
    grams = f"list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2])"
    return f"(CASE WHEN len({t}) < 6 THEN 0.0 ELSE least(0.2, (len({grams}) - len(list_distinct({grams}))) * 1.0 / len({grams})) END)"


def exact(h: str, s: str) -> str:
    return f"(coalesce({s}, '') <> '' AND lower({norm(h)}) = lower({norm(s)}))"


def scored_pairs() -> str:
    """CTEs pairs, n (normalised), w (tokens), f (flags) and scored."""
    ends = " OR ".join(f"right({{c}}, 1) = '{e}'" for e in SENTENCE_ENDS)
    letters = "list_distinct(regexp_extract_all(lower({c}), '\\p{{L}}'))"
    spanish = f"len(list_intersect(sw, {listing(SPANISH_SIGNAL)})) > 0"
    quechua = f"(len(list_intersect(tw, {listing(QUECHUA_SIGNAL)})) > 0 OR len(list_filter(tw, lambda x: regexp_matches(x, '({'|'.join(QUECHUA_ENDINGS)})$'))) > 0)"
    tests = {
        "empty_side": "source = '' OR target = ''",
        "too_short": "length(source) < 18 OR length(target) < 18",
        "too_long": "length(source) > 700 OR length(target) > 700",
        "too_few_words": "len(sw) < 3 OR len(tw) < 3",
        "punct_or_numbers_only": "regexp_full_match(source, '[^\\p{L}]+') OR regexp_full_match(target, '[^\\p{L}]+')",
        "bracketed_metadata": "regexp_full_match(source, '[\\[(].{0,80}[\\])]') OR regexp_full_match(target, '[\\[(].{0,80}[\\])]')",
        "extreme_length_ratio": "length_ratio < 0.32 OR length_ratio > 3.2",
        "exact_copy": "lower(source) = lower(target)",
        "high_overlap_copy_risk": f"{share('sw', 'tw')} > 0.62 AND {share(letters.format(c='source'), letters.format(c='target'))} > 0.72",
        "weak_spanish_signal": f"NOT ({spanish})",
        "weak_quechua_signal": f"NOT ({quechua})",
    }
    flags = ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items())
    penalty = " + ".join(f"CASE WHEN list_contains(flags, '{n}') THEN {p} ELSE 0 END" for n, p in FLAG_PENALTIES.items())
    both = f"({ends.format(c='source')}) AND ({ends.format(c='target')})"
    return f"""WITH {PAIRS}, n AS (SELECT conv_id, turn, {pair_norm('source')} AS source, {pair_norm('target')} AS target FROM pairs),
w AS (SELECT *, {words('source')} AS sw, {words('target')} AS tw, length(target) * 1.0 / greatest(length(source), 1) AS length_ratio FROM n),
f AS (SELECT *, list_filter([{flags}], lambda x: x IS NOT NULL) AS flags FROM w),
scored AS (SELECT *, least(1.0, greatest(0.0, 1.0 - ({penalty}) + CASE WHEN length_ratio BETWEEN 0.65 AND 1.75 THEN 0.06 ELSE 0 END + CASE WHEN {both} THEN 0.04 ELSE 0 END)) AS quality_score FROM f),
tiers AS (SELECT *, len(flags) = 0 AS is_high, quality_score >= 0.72 AND len(list_intersect(flags, {listing(HARD_FLAGS)})) = 0 AS is_broad FROM scored)"""


def pool_signals() -> str:
    """CTEs pool and sig."""
    return f"""WITH {POOL}, tok AS (SELECT *, {tokens('prediction')} AS tokens, {tokens('source')} AS source_tokens, {tokens('reference')} AS reference_tokens FROM pool),
sig AS (SELECT *, {copied('tokens', 'source_tokens')} AS copied, {leak('tokens')} AS leak, {artifacts('prediction')} AS artifacts, {repeated('tokens')} AS repeated, {exact('prediction', 'source')} AS exact, len(tokens) AS n_tokens FROM tok)"""


def split_words(c: str) -> str:
    marks = "'" + PUNCTUATION.replace("'", "''") + "'"
    parts = f"CASE WHEN length(w) = 1 THEN [w] WHEN contains({marks}, right(w, 1)) THEN [left(w, length(w) - 1), right(w, 1)] WHEN contains({marks}, left(w, 1)) THEN [left(w, 1), right(w, length(w) - 1)] ELSE [w] END"
    return f"(CASE WHEN {norm(c)} = '' THEN []::VARCHAR[] ELSE flatten(list_transform(string_split({norm(c)}, ' '), lambda w: {parts})) END)"


def evaluation_tokens(c: str) -> str:
    t = rf"regexp_replace(coalesce({c}, ''), '<skipped>|-\n', '', 'g')"
    for a, b in (("chr(10)", "' '"), ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        t = f"replace({t}, {a}, {b})"
    t = f"(' ' || {t} || ' ')"
    t = rf"regexp_replace({t}, '([\x20-\x26\x28-\x2B\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])', ' \1 ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g')"
    t = norm(rf"regexp_replace({t}, '([0-9])(-)', '\1 \2 ', 'g')")
    return f"(CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, ' ') END)"


def letter_grams(keys: str, text: str, source: str, side: str) -> str:
    """(keys, side, ord, g) for the orders 1 to 6 of characters without space and 7 to 8 of words."""
    inner = f"SELECT {keys}, replace({norm(text)}, ' ', '') AS t, {split_words(text)} AS w FROM {source}"
    chars = [f"SELECT {keys}, '{side}' AS side, {n} AS ord, unnest(list_transform(range(1, length(t) - {n} + 2), lambda i: substring(t, i, {n}))) AS g FROM ({inner})" for n in range(1, 7)]
    pairs = [f"SELECT {keys}, '{side}' AS side, {6 + n} AS ord, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS g FROM ({inner})" for n in (1, 2)]
    return " UNION ALL ".join(chars + pairs)


def f_score(h: str, r: str, m: str, where: str = "true") -> str:
    """Aggregate over orders: F2 of mean precision and mean recall over the orders that both sides have."""
    p, q = (f"coalesce(avg({m} * 1.0 / {x}) FILTER ({h} > 0 AND {r} > 0 AND {where}), 0)" for x in (h, r))
    return f"CASE WHEN {p} + {q} > 0 THEN 5.0 * {p} * {q} / (4.0 * {p} + {q}) ELSE 0 END"


def common(a: str, b: str) -> str:
    """How many items two lists share, with multiplicities."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"


def entities(c: str) -> str:
    """Distinct numbers and whole words that begin with a capital and hold letters only."""
    return f"list_distinct(list_concat(regexp_extract_all({c}, '\\b\\d+(?:[.,]\\d+)*\\b'), list_filter(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-ZÁÉÍÓÚÜÑ][A-ZÁÉÍÓÚÜÑa-záéíóúüñ]{{2,}}'))))"


def steps(value: str, bounds, other: str, below: bool = False) -> str:
    return "CASE " + " ".join(f"WHEN {value} {'<' if below else '>='} {b} THEN {p}" for b, p in bounds) + f" ELSE {other} END"
