"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The characters a browser script counts as white space: the ASCII
# controls, all separators and the byte order mark. Java's own \s is ASCII only.
# Three ranges are also several times faster to test than the list written out.
WS = r"[\t-\r\p{Z}\x{feff}]"

# What counts as a tag and as an entity, and which elements are
# dropped whole or separate words.
TAG = r"</?[a-zA-Z][^>]*>"
ENTITY = r"&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);"
NON_CONTENT_ELEMENTS = "script|style|noscript|template"
BLOCK_ELEMENTS = (
    "p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer"
    "|blockquote|figure|figcaption|hr"
)
COMMENT = r"<!--[\s\S]*?-->"
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "ndash": "–", "mdash": "—", "hellip": "…",
    "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”",
}

_WORD_END = r"(?![0-9A-Za-z_])"
_NON_CONTENT = rf"(?i)<({NON_CONTENT_ELEMENTS}){_WORD_END}[^>]*>[\s\S]*?</\1{WS}*>"
_BLOCK_TAG = rf"(?i)</?(?:{BLOCK_ELEMENTS}){_WORD_END}[^>]*>"

# An astral character is often written as two entities, one per UTF-16 unit.
# Matching such a pair as one token keeps the character whole.
_HIGH_UNIT = (
    r"&#(?:x0*[dD][89abAB][0-9a-fA-F]{2}"
    r"|0*(?:55(?:29[6-9]|[3-9]\d\d)|56(?:[0-2]\d\d|3[01]\d))(?:[a-fA-F][0-9a-fA-F]*)?);"
)
_LOW_UNIT = (
    r"&#(?:x0*[dD][c-fC-F][0-9a-fA-F]{2}"
    r"|0*(?:56(?:3[2-9]\d|[4-9]\d\d)|57(?:[0-2]\d\d|3[0-3]\d|34[0-3]))(?:[a-fA-F][0-9a-fA-F]*)?);"
)
_TOKEN = rf"{_HIGH_UNIT}{_LOW_UNIT}|{ENTITY}"


def collapse_ws(c: Column) -> Column:
    """Runs of white space as one space, none at the ends. A single plain space, which is nearly
    every run, is no match and so is not copied; visible ASCII is passed by one range test."""
    return F.trim(F.regexp_replace(c, rf"(?![!-~])(?:(?! ){WS}+| {WS}+)", " "))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# A character that marks openers which can no longer match (see ``drop_non_content``). Text that
# already holds it takes the plain path, so results never depend on it.
MARK = "\ue000"
_NAMES = NON_CONTENT_ELEMENTS.split("|")


def _let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` evaluated once, however often ``body`` refers to it (a lambda
    variable of a one-element ``transform``): layers of text work are not computed again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _split_at(c: Column, place: Column) -> tuple[Column, Column]:
    """Text up to ``place`` (1-based, inclusive) and the rest."""
    return F.substring(c, F.lit(1), place), F.substring(c, place + 1, F.length(c))


def _last_gt(c: Column) -> Column:
    return F.length(c) - F.length(F.substring_index(c, ">", -1))


def _before_last_gt(c: Column, pattern: str, replacement: str) -> Column:
    """``regexp_replace`` for a pattern whose matches end at the first ``>`` after their start:
    none starts after the last ``>``, so only the text up to it is searched. Otherwise every start
    without a ``>`` after it would scan to the end of the text (quadratic). Text without a ``<``
    after it has no such start and is not cut."""
    def cut(x: Column) -> Column:
        return _let(_last_gt(x), lambda place: F.concat(F.regexp_replace(_split_at(x, place)[0], pattern, replacement), _split_at(x, place)[1]))

    whole = lambda x: F.regexp_replace(x, pattern, replacement)
    return _let(c, lambda x: F.when(F.substring_index(x, ">", -1).contains("<"), cut(x)).otherwise(whole(x)))


def looks_like_html(c: Column) -> Column:
    return _let(c, lambda x: (x.contains("<") & F.substring(x, F.lit(1), _last_gt(x)).rlike(TAG)) | (x.contains("&") & x.rlike(ENTITY)))


def _marked_dead_elements(c: Column) -> Column:
    """An opener of script, style, noscript or template after the end of the last closing tag of
    its name can match nothing; its ``<`` becomes ``MARK`` (one character for one, so places stay).
    Names without an opener, or with none after that tag, leave the text as it is."""
    def marker(name: str):
        opener = rf"(?i)<(?={name}{_WORD_END})"

        def mark(x: Column) -> Column:
            def marked(tail: Column) -> Column:
                head = F.substring(x, F.lit(1), F.length(x) - F.length(tail))
                return F.when(tail.rlike(opener), F.concat(head, F.regexp_replace(tail, opener, MARK))).otherwise(x)

            # Greedy to the end of the text and back to the last closing tag.
            after = F.regexp_replace(x, rf"(?is)\A.*</{name}{WS}*>", "")
            return F.when(x.rlike(opener), _let(after, marked)).otherwise(x)

        return mark

    for name in _NAMES:
        c = _let(c, marker(name))
    return c


def _marked_dead_comments(c: Column) -> Column:
    """A ``<!--`` that has no ``-->`` starting four or more characters after it can match nothing:
    it lies after the last ``-->`` or shares characters with it, which is asked first."""
    def mark(x: Column) -> Column:
        found = F.instr(F.reverse(x), ">--")
        cut = F.when(found > 0, F.greatest(F.length(x) - found - 5, F.lit(0))).otherwise(F.lit(0))

        def split(place: Column) -> Column:
            head, tail = _split_at(x, place)
            return F.concat(head, F.regexp_replace(tail, "<!--", MARK + "!--"))

        dead = F.substring_index(x, "-->", -1).contains("<!--") | x.contains("<!-->") | x.contains("<!--->")
        return F.when(dead, _let(cut, split)).otherwise(x)

    return _let(c, mark)


def _code_out(x: Column, fast: bool) -> Column:
    if not fast:
        return F.regexp_replace(x, _NON_CONTENT, " ")
    out = F.replace(F.regexp_replace(_marked_dead_elements(x), _NON_CONTENT, " "), F.lit(MARK), F.lit("<"))
    return F.when(x.rlike(rf"(?i)<(?:{NON_CONTENT_ELEMENTS}){_WORD_END}"), out).otherwise(x)


def drop_non_content(c: Column) -> Column:
    """Script, style, noscript and template elements replaced by a space.

    Linear in the text: an opener whose element never closes would make the lazy pattern scan the
    rest of the text once per opener, so such openers are marked first and unmarked after. Text
    that holds ``MARK`` itself takes the plain pattern (same result, not linear).
    """
    return _let(c, lambda x: F.when(x.contains(MARK), _code_out(x, False)).otherwise(_code_out(x, True)))


def drop_tags(c: Column) -> Column:
    """Code, block tags, comments, other tags; each pass sees the one before.

    Every pass is linear in the text (see ``drop_non_content``, ``_before_last_gt``); comments
    that never close are marked like code elements.
    """
    def passes(x: Column, fast: bool) -> Column:
        spaced = _before_last_gt(_code_out(x, fast), _BLOCK_TAG, " ")
        if fast:
            spaced = _let(spaced, lambda y: F.when(y.contains("<!--"), F.replace(
                F.regexp_replace(_marked_dead_comments(y), COMMENT, " "), F.lit(MARK), F.lit("<"))).otherwise(y))
        else:
            spaced = F.regexp_replace(spaced, COMMENT, " ")
        return _before_last_gt(spaced, TAG, "")

    return _let(c, lambda x: F.when(x.contains(MARK), passes(x, False)).otherwise(passes(x, True)))


def _code_point(token: str) -> str:
    """SQL: number of a numeric entity, or null. Leading zeros do not count."""
    hexa = rf"regexp_extract({token}, r'\A&#x0*([0-9a-fA-F]*);', 1)"
    deci = rf"regexp_extract({token}, r'\A&#0*([0-9]*)', 1)"
    return (
        f"CASE WHEN {token} LIKE '&#x%' THEN CASE WHEN length({hexa}) <= 6 THEN CAST(conv('0' || {hexa}, 16, 10) AS INT) END"
        rf" WHEN {token} RLIKE r'\A&#[0-9]' THEN CASE WHEN length({deci}) <= 7 THEN CAST('0' || {deci} AS INT) END END"
    )


def _character(code: str) -> str:
    return f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')"


def _decoded(token: str) -> str:
    names = ", ".join(f"'{name}', '{chr(92) if char == chr(39) else ''}{char}'" for name, char in NAMED_ENTITIES.items())
    code = _code_point(token)
    return (
        f"CASE WHEN {token} NOT LIKE '&#%' THEN coalesce(try_element_at(map({names}), lower(trim(BOTH '&;' FROM {token}))), {token})"
        f" WHEN ({code}) IS NULL OR ({code}) > 1114111 THEN {token}"
        f" WHEN ({code}) BETWEEN 55296 AND 57343 THEN '\ufffd' ELSE {_character(code)} END"
    )


def _decoded_or_pair(token: str) -> str:
    high, low = _code_point(token), _code_point(f"('&' || substring_index({token}, '&', -1))")
    joined = _character(f"((({high}) - 55296) * 1024 + (({low}) - 56320) + 65536)")
    return f"CASE WHEN {token} RLIKE '&.+&' THEN {joined} ELSE {_decoded(token)} END"


def _replace_tokens(column: str, pattern: str, decoded: str) -> str:
    return (
        f"array_join(zip_with(split({column}, r'{pattern}', -1),"
        f" transform(regexp_extract_all({column}, r'{pattern}', 0), t -> {decoded}),"
        " (a, b) -> concat(a, coalesce(b, ''))), '')"
    )


def decode_entities(column: str) -> Column:
    """One pass over a column given by name: decoded text is not looked at
    again. The slower pattern with pairs is used only for text that holds one."""
    return F.expr(
        f"CASE WHEN contains({column}, '&#') AND {column} RLIKE r'{_HIGH_UNIT}'"
        f" THEN {_replace_tokens(column, _TOKEN, _decoded_or_pair('t'))}"
        f" WHEN contains({column}, '&') THEN {_replace_tokens(column, ENTITY, _decoded('t'))} ELSE {column} END"
    )


def with_clean_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds ``out`` for every ``{out: in}``: markup removed, entities decoded,
    white space collapsed, empty text null.

    The steps are separate layers so that no expensive expression is evaluated
    twice. Text without tags and entities passes the decode layer unchanged.
    """
    df = df.withColumns({
        f"_bare_{out}": F.when(looks_like_html(F.col(src)), drop_tags(F.col(src))).otherwise(F.col(src))
        for out, src in columns.items()
    })
    df = df.withColumns({
        out: null_if_empty(collapse_ws(decode_entities(f"_bare_{out}"))) for out in columns
    })
    return df.drop(*[f"_bare_{out}" for out in columns])
