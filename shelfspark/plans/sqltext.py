"""SQL fragments for text analysis, as the oracle's dialect has them."""

from __future__ import annotations

import unicodedata

from shelfspark.functions.words import CJK, ENTITIES, STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


#: Code points whose compatibility form is one other code point: spaces, full- and half-width forms; by rule, not by list.
_SINGLE = [c for r in ((0xA0, 0x100), (0x2000, 0x2070), (0x3000, 0x3001), (0xFF01, 0xFFF0)) for c in map(chr, range(*r)) if len(unicodedata.normalize("NFKC", c)) == 1 and unicodedata.normalize("NFKC", c) != c]


def sql_nfkc(x: str) -> str:
    """Compatibility-composed form, as far as the tables have such signs: single code points and Latin ligatures."""
    quoted = lambda t: t.replace("'", "''")
    t = f"translate({x}, '{quoted(''.join(_SINGLE))}', '{quoted(''.join(unicodedata.normalize('NFKC', c) for c in _SINGLE))}')"
    for c in map(chr, range(0xFB00, 0xFB07)):
        t = f"replace({t}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    return f"nfc_normalize({t})"


def sql_normalize(x: str) -> str:
    t = f"lower(coalesce({sql_nfkc(x)}, ''))"
    for pattern, by in (("[’`´]", "''"), (r"(\d),(\d{3})\b", r"\1\2"), (r"(\d),(\d)", r"\1.\2"), (r"(\d)([a-zà-ɏ])", r"\1 \2"), (r"([a-zà-ɏ])(\d)", r"\1 \2")):
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    return t


def sql_stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) < 4 OR right({w}, 1) <> 's' THEN {w} WHEN regexp_matches({w}, '^\\p{{L}}{{2,}}[^aeiou\\d]ies$') THEN regexp_replace({w}, 'ies$', 'y') "
        f"WHEN regexp_matches({w}, '^\\p{{L}}{{2,}}(ss|sh|ch|x|z)es$') THEN regexp_replace({w}, 'es$', '') WHEN regexp_matches({w}, '^\\p{{L}}{{2,}}[^su\\d]s$') THEN regexp_replace({w}, 's$', '') ELSE {w} END"
    )


def sql_terms(x: str) -> str:
    """Index terms: stems of words that are no stop words, then bigrams of the Japanese runs."""
    t = sql_normalize(x)
    words = f"list_filter(regexp_extract_all(regexp_replace({t}, '[{CJK}]+', ' ', 'g'), '\\d+(?:\\.\\d+)?|[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({_STOP}))"
    runs = f"regexp_extract_all({t}, '[{CJK}]+')"
    grams = f"flatten(list_transform({runs}, lambda r: CASE WHEN length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i::INT, 2)) END))"
    return f"list_concat(list_transform({words}, lambda w: {sql_stem('w')}), {grams})"


def sql_units(x: str) -> str:
    """Words that are no stop words, then the runs of Japanese script."""
    t = sql_normalize(x)
    words = f"list_filter(regexp_extract_all(regexp_replace({t}, '[{CJK}]+', ' ', 'g'), '\\d+(?:\\.\\d+)?|[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({_STOP}))"
    return f"list_concat({words}, regexp_extract_all({t}, '[{CJK}]+'))"


def sql_without_markup(x: str) -> str:
    t = f"regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>|</p>|</li>|</div>', ' ', 'g'), '<[^>]{{0,200}}>', ' ', 'g')"
    for entity, sign in sorted(ENTITIES.items(), key=lambda e: e[0] == "&amp;"):
        sign = sign.replace("'", "''")
        t = f"replace({t}, '{entity}', '{sign}')"
    return t


def sql_visible(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[\u00ad\u200b-\u200f\ufeff]', '', 'g'), '[\\s\\p{{Z}}\u0085\u000b]+', ' ', 'g'))"
