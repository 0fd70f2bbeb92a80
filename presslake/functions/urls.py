"""Links brought to one canonical form.

The parts are cut out with regular expressions, because Spark's own URL parser
refuses much of what browsers accept. Rare work (foreign hosts, numeric hosts,
dot segments, percent encoding) sits behind a cheap test of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslake.functions.text import collapse_ws, null_if_empty

# Query parameters that only track the visitor.
TRACKING_PARAMETERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "fbclid", "gclid", "dclid", "msclkid", "igshid", "mc_cid", "mc_eid",
    "ref", "ref_src", "source", "spm",
]

# Characters written as %XX in a path and in a user name, and those
# no host may hold.
PATH_ESCAPED = r"[\x00-\x20\"#<>?^`{}\x{7f}-\x{10ffff}]"
USER_ESCAPED = r"[\x00-\x20\"#<>?^`{}/:;=@\[\]\\|\x{7f}-\x{10ffff}]"
HOST_FORBIDDEN = r"[\x00-\x20#/:<>?@\[\]\\^|%\x{7f}-\x{10ffff}]"
DOT_SEGMENT = r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"
# Characters that the JDK's host encoder (the 2003 rules) folds away or drops, which
# would make one host of two. Hosts with them stay in their own letters.
DEVIATING = r"[\x{df}\x{1e9e}\x{3c2}\x{200c}\x{200d}]"
# Bootstring parameters of Punycode (RFC 3492) and its digits in order.
PUNY_BASE, PUNY_TMIN, PUNY_TMAX, PUNY_SKEW, PUNY_DAMP, PUNY_BIAS, PUNY_N = 36, 1, 26, 38, 700, 72, 128
PUNY_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Dots that UTS-46 maps to a full stop (ideographic, fullwidth, halfwidth).
LABEL_DOTS = "\u3002\uff0e\uff61"
NUMERIC_HOST = r"(?:\A|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z"

_PLUS_KEPT = "replace(_url_host, '+', '%2B')"

_TEMPORARY = [
    "_url_link", "_url_scheme", "_url_rest", "_url_authority", "_url_tail", "_url_user", "_url_place", "_url_host", "_url_port",
    "_url_ascii_host", "_url_final_host", "_url_path", "_url_query",
]


def _escape(text: str, characters: str) -> str:
    """SQL: ``text`` with runs of ``characters`` percent-encoded."""
    return (
        f"CASE WHEN {text} RLIKE r'{characters}' THEN array_join(zip_with(split({text}, r'{characters}+', -1),"
        f" transform(regexp_extract_all({text}, r'{characters}+', 0), run -> replace(url_encode(run), '+', '%20')),"
        f" (a, b) -> concat(a, coalesce(b, ''))), '') ELSE {text} END"
    )


def _decode(text: str) -> str:
    """SQL: percent decoding that leaves a stray percent sign alone."""
    return f"url_decode(regexp_replace({text}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"


def canonical_query(query: str) -> Column:
    """Parameters without the tracking ones, in stable order of their names."""
    tracking = ", ".join(f"'{name}'" for name in TRACKING_PARAMETERS)
    name = _decode("substring_index(p, '=', 1)")
    value = _decode("substring(p, instr(p, '=') + 1)")
    value = f"CASE WHEN contains(p, '=') THEN {value} ELSE '' END"
    entries = (
        f"transform(filter(split({query}, '&', -1), p -> p <> ''), (p, i) -> named_struct("
        f"'name', {name}, 'position', i, 'value', {value}))"
    )
    return F.expr(
        f"CASE WHEN {query} = '' THEN '' ELSE array_join(transform(array_sort(filter({entries},"
        f" e -> lower(e.name) NOT IN ({tracking}))), e -> concat(url_encode(e.name), '=', url_encode(e.value))), '&') END"
    )


def resolve_dots(path: str) -> Column:
    segment = "regexp_replace(segment, '(?i)%2e', '.')"
    kept = (
        f"array_join(aggregate(split(substring({path}, 2), '/', -1), CAST(array() AS ARRAY<STRING>), (done, segment) ->"
        f" CASE {segment} WHEN '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) WHEN '.' THEN done"
        " ELSE array_append(done, segment) END), '/')"
    )
    # A path that ends in a dot segment names a folder.
    return F.expr(
        f"CASE WHEN NOT {path} RLIKE r'{DOT_SEGMENT}' THEN {path}"
        rf" WHEN {path} RLIKE r'(?i)/(?:\.|%2e){{1,2}}\z' AND {kept} <> '' THEN concat('/', {kept}, '/') ELSE concat('/', {kept}) END"
    )


def numeric_host(host: str) -> str:
    """SQL: dotted form of a host written as one to four numbers, or null. A
    number may be octal or hexadecimal; the last one fills the bytes left."""
    number = (
        r"CASE WHEN t RLIKE r'\A0x0*[0-9a-f]{0,11}\z' THEN CAST(conv('0' || regexp_replace(substring(t, 3), r'\A0+', ''), 16, 10) AS BIGINT)"
        r" WHEN t RLIKE r'\A0+[0-7]{0,12}\z' THEN CAST(conv('0' || regexp_replace(t, r'\A0+', ''), 8, 10) AS BIGINT)"
        r" WHEN t RLIKE r'\A[1-9][0-9]*\z' THEN try_cast(t AS BIGINT) END"
    )
    numbers = rf"transform(split(regexp_replace({host}, r'\.\z', ''), r'\.', -1), t -> {number})"
    heads = f"slice({numbers}, 1, size({numbers}) - 1)"
    valid = (
        f"size({numbers}) <= 4 AND NOT exists({numbers}, n -> n IS NULL) AND forall({heads}, n -> n <= 255)"
        f" AND element_at({numbers}, -1) < shiftleft(1L, 8 * (5 - size({numbers})))"
    )
    address = (
        f"(aggregate(transform({heads}, (n, i) -> shiftleft(n, 24 - 8 * i)), 0L, (total, n) -> total + n) + element_at({numbers}, -1))"
    )
    octets = ", ".join(f"CAST(shiftright({address}, {bits}) & 255 AS STRING)" for bits in (24, 16, 8, 0))
    return f"CASE WHEN {valid} THEN concat_ws('.', {octets}) END"


def address_host(host: str) -> str:
    """SQL: an IPv6 host in its shortest form, brackets included, or null if it is none."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    tail = r"regexp_extract(t, '([^:]*)$', 1)"
    pair = "lower(hex(CAST(split({0}, '[.]')[{1}] AS INT) * 256 + CAST(split({0}, '[.]')[{2}] AS INT)))"
    # A last part in dotted form is two groups.
    plain = (
        f"CASE WHEN NOT contains(t, '.') THEN t WHEN {tail} RLIKE r'\\A{octet}(?:[.]{octet}){{3}}\\z' THEN"
        f" concat(substring(t, 1, length(t) - length({tail})), {pair.format(tail, 0, 1)}, ':', {pair.format(tail, 2, 3)}) END"
    )
    # One double colon stands for the groups that are missing, at least one.
    given = "size(filter(split(t, ':'), g -> g <> ''))"
    zeros = f"array_join(array_repeat('0', 8 - {given}), ':')"
    whole = (
        f"CASE WHEN NOT contains(t, '::') THEN t WHEN {given} < 8 AND instr(substring(t, instr(t, '::') + 1), '::') = 0"
        f" THEN trim(BOTH ':' FROM concat(substring_index(t, '::', 1), ':', {zeros}, ':', substring(t, instr(t, '::') + 2))) END"
    )
    groups = r"transform(split(t, ':', -1), g -> regexp_replace(g, '^0+(?=.)', ''))"
    checked = rf"CASE WHEN t RLIKE r'\A[0-9a-f]{{1,4}}(?::[0-9a-f]{{1,4}}){{7}}\z' THEN array_join({groups}, ':') END"
    runs = " ".join(
        rf"WHEN t RLIKE r'(?:\A|:)0(?::0){{{k}}}(?::|\z)' THEN regexp_replace(t, r'\A(.*?)(?:\A|:)0(?::0){{{k}}}(?::|\z)(.*)\z', '$1::$2')"
        for k in range(7, 0, -1)
    )
    value = f"substring({host}, 2, length({host}) - 2)"
    for step in (plain, whole, checked, f"CASE {runs} ELSE t END"):
        value = f"transform(array({value}), t -> {step})[0]"
    return f"concat('[', {value}, ']')"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _literal(text: str) -> str:
    """Text escaped for a quoted SQL string."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _puny_digit(d: str) -> str:
    return f"substring('{PUNY_DIGITS}', CAST({d} AS INT) + 1, 1)"


def _puny_number(q: str, bias: str) -> str:
    """SQL: ``q`` as a generalised variable-length integer under ``bias`` (RFC 3492, 6.3).
    Each digit divides what is left by at least 10, so 20 digits cover any long."""
    t = f"least(greatest({PUNY_BASE} * i - {bias}, {PUNY_TMIN}), {PUNY_TMAX})"
    step = (
        f"CASE WHEN a.done THEN a WHEN a.q < {t} THEN {_struct({'q': 'a.q', 'out': f'concat(a.out, {_puny_digit('a.q')})', 'done': 'true'})}"
        f" ELSE {_struct({'q': f'(a.q - {t}) div ({PUNY_BASE} - {t})', 'out': f'concat(a.out, {_puny_digit(f'{t} + (a.q - {t}) % ({PUNY_BASE} - {t})')})', 'done': 'false'})} END"
    )
    return f"aggregate(sequence(1, 20), {_struct({'q': q, 'out': "''", 'done': 'false'})}, (a, i) -> {step}).out"


def _puny_adapt(delta: str, points: str, first: str) -> str:
    """SQL: the next bias (RFC 3492, 6.1). Each round divides by 35, so 20 rounds cover any long."""
    start = f"(CASE WHEN {first} THEN {delta} div {PUNY_DAMP} ELSE {delta} div 2 END)"
    start = f"({start} + {start} div ({points}))"
    limit = ((PUNY_BASE - PUNY_TMIN) * PUNY_TMAX) // 2
    rounds = (
        f"aggregate(sequence(1, 20), named_struct('d', {start}, 'k', 0L), (r, ri) -> CASE WHEN r.d > {limit}"
        f" THEN named_struct('d', r.d div {PUNY_BASE - PUNY_TMIN}, 'k', r.k + {PUNY_BASE}) ELSE r END)"
    )
    return _let(rounds, "ad", f"ad.k + ({PUNY_BASE - PUNY_TMIN + 1} * ad.d) div (ad.d + {PUNY_SKEW})")


def punycode(label: str) -> str:
    """SQL: the Punycode (RFC 3492) form of a label, without the ``xn--`` prefix.

    The encoder walks one event per pair (code point m above those done, position j), which is
    the two loops of the RFC laid flat; the state carries n, delta, bias, h and the output.
    Labels are at most a few dozen characters, so the events are few.
    """
    cps = f"transform(regexp_extract_all({label}, '(?s)(.)', 1), ch -> ascii(ch))"
    basic = f"array_join(filter(regexp_extract_all({label}, '(?s)(.)', 1), ch -> ascii(ch) < {PUNY_N}), '')"
    start = _struct({
        "n": f"{PUNY_N}L", "delta": "0L", "bias": f"{PUNY_BIAS}L", "h": "CAST(length(bs) AS BIGINT)",
        "out": f"CASE WHEN length(bs) > 0 THEN concat(bs, '-') ELSE '' END",
    })
    events = (
        f"flatten(transform(array_sort(array_distinct(filter(cp, c -> c >= {PUNY_N}))),"
        f" m -> transform(sequence(1, size(cp)), j -> named_struct('m', CAST(m AS BIGINT), 'j', j))))"
    )
    # Before the first position of a new code point: skip the deltas of those below it.
    s1 = (
        f"CASE WHEN e.j = 1 THEN {_struct({'n': 'e.m', 'delta': 's.delta + (e.m - s.n) * (s.h + 1)', 'bias': 's.bias', 'h': 's.h', 'out': 's.out'})}"
        " ELSE s END"
    )
    # At each position: count smaller code points, write a delta at equal ones.
    emit = _struct({
        "n": "t.n", "delta": "0L", "bias": _puny_adapt("t.delta", "t.h + 1", "t.h = length(bs)"), "h": "t.h + 1",
        "out": f"concat(t.out, {_puny_number('t.delta', 't.bias')})",
    })
    s2 = (
        f"CASE WHEN element_at(cp, e.j) < t.n THEN {_struct({'n': 't.n', 'delta': 't.delta + 1', 'bias': 't.bias', 'h': 't.h', 'out': 't.out'})}"
        f" WHEN element_at(cp, e.j) = t.n THEN {emit} ELSE t END"
    )
    # After the last position: on to the next code point.
    s3 = f"CASE WHEN e.j = size(cp) THEN {_struct({'n': 'u.n + 1', 'delta': 'u.delta + 1', 'bias': 'u.bias', 'h': 'u.h', 'out': 'u.out'})} ELSE u END"
    step = _let(_let(s1, "t", s2), "u", s3)
    walk = f"aggregate({events}, {start}, (s, e) -> {step}).out"
    return _let(cps, "cp", _let(basic, "bs", walk))


def uts46_host(host: str) -> str:
    """SQL: a host as UTS-46 nontransitional processing and Punycode write it, as browsers do.

    Mapping: fullwidth ASCII to ASCII, the three other full stops to ``.``, capital sharp s to
    ``ss``, capital sigma to small sigma, then lower case. The deviation letters (sharp s, final sigma, zero-width joiners) stay,
    so ``straße.de`` is ``xn--strae-oqa.de`` and differs from ``strasse.de``. Every label with
    a letter beyond ASCII becomes ``xn--`` and its Punycode. Not done: NFC composition (a letter
    written as base and combining mark stays two code points) and the disallowed code points
    of UTS-46, which are encoded like any other.
    """
    # Capital sigma to the plain small one: lower() would write a final sigma at a word's end.
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u03a3"
    narrow = "".join(chr(c) for c in range(0x21, 0x7F)) + "\u03c3"
    mapped = (
        f"lower(replace(translate(translate({host}, '{_literal(wide)}', '{_literal(narrow)}'), '{LABEL_DOTS}', '...'),"
        " '\u1e9e', 'ss'))"
    )
    labels = (
        f"transform(split(hm, '[.]', -1), lb -> CASE WHEN lb RLIKE '[^\\x00-\\x7f]' THEN concat('xn--', {punycode('lb')})"
        " ELSE lb END)"
    )
    return _let(mapped, "hm", f"array_join({labels}, '.')")


def with_canonical_url(df: DataFrame, link: str, out: str = "url", raw_out: str = "url_raw") -> DataFrame:
    """Adds the canonical link and the collapsed spelling; both null if the
    value is no http or https address."""
    c = F.col
    df = df.withColumn("_url_link", null_if_empty(collapse_ws(c(link))))
    df = df.withColumns({
        "_url_scheme": F.lower(F.regexp_extract(c("_url_link"), r"(?i)\A[\x00-\x20]*(https?):", 1)),
        "_url_rest": F.regexp_extract(c("_url_link"), r"(?is)\A[\x00-\x20]*https?:[/\\]*(.*?)[\x00-\x20]*\z", 1),
    })
    df = df.withColumns({
        "_url_authority": F.regexp_extract(c("_url_rest"), r"\A([^/\\?#]*)", 1),
        "_url_tail": F.regexp_replace(c("_url_rest"), r"\A[^/\\?#]*", ""),
    })
    df = df.withColumns({
        "_url_user": F.when(c("_url_authority").contains("@"), F.regexp_extract(c("_url_authority"), r"(?s)\A(.*)@", 1)).otherwise(F.lit("")),
        "_url_place": F.regexp_extract(c("_url_authority"), r"([^@]*)\z", 1),
        "_url_path": F.translate(F.regexp_extract(c("_url_tail"), r"\A([^?#]*)", 1), "\\", "/"),
        "_url_query": F.regexp_extract(c("_url_tail"), r"\A[^?#]*\?([^#]*)", 1),
    })
    place = r"\A(\[[^\]]*\]|[^:]*)(?::([0-9]*))?\z"
    df = df.withColumns({
        "_url_host": F.regexp_extract(c("_url_place"), place, 1),
        "_url_port": F.regexp_replace(F.regexp_extract(c("_url_place"), place, 2), r"\A0+(?=[0-9])", ""),
    })
    # Percent signs first, then letters of other scripts by the JDK's own encoder.
    df = df.withColumn("_url_ascii_host", F.expr(
        f"CASE WHEN contains(_url_host, '%') THEN {_decode(_PLUS_KEPT)} ELSE _url_host END"
    ))
    df = df.withColumn("_url_ascii_host", F.expr(
        rf"lower(CASE WHEN _url_ascii_host RLIKE r'{DEVIATING}' THEN _url_ascii_host"
        r" WHEN _url_ascii_host RLIKE r'[^\x00-\x7f]' THEN try_reflect('java.net.IDN', 'toASCII', _url_ascii_host)"
        " ELSE _url_ascii_host END)"
    ))
    df = df.withColumn("_url_final_host", F.expr(
        rf"CASE WHEN _url_ascii_host RLIKE r'\A\[[0-9a-f:.]+\]\z' THEN {address_host('_url_ascii_host')}"
        rf" WHEN _url_ascii_host = '' OR regexp_replace(_url_ascii_host, CASE WHEN _url_ascii_host RLIKE r'{DEVIATING}'"
        rf" THEN r'[\x{{80}}-\x{{10ffff}}]' ELSE r'\A\z' END, '') RLIKE r'{HOST_FORBIDDEN}' THEN NULL WHEN _url_ascii_host RLIKE r'{NUMERIC_HOST}' THEN {numeric_host('_url_ascii_host')}"
        r" ELSE regexp_replace(_url_ascii_host, r'\Awww\.(?=.)', '') END"
    ))
    word = _escape("substring_index(_url_user, ':', 1)", USER_ESCAPED)
    secret = _escape("substring(_url_user, instr(_url_user, ':') + 1)", USER_ESCAPED)
    df = df.withColumns({
        "_url_final_host": F.expr(f"CASE WHEN _url_final_host RLIKE r'{NUMERIC_HOST}' THEN {numeric_host('_url_final_host')} ELSE _url_final_host END"),
        "_url_path": F.expr(f"CASE WHEN _url_path = '' THEN '/' ELSE {_escape('_url_path', PATH_ESCAPED)} END"),
        "_url_query": canonical_query("_url_query"),
        # An empty password loses its colon, an empty user part its at sign.
        "_url_user": F.expr(
            f"CASE WHEN _url_user IN ('', ':') THEN '' WHEN contains(_url_user, ':') AND NOT endswith(_url_user, ':')"
            f" THEN concat({word}, ':', {secret}, '@') WHEN instr(_url_user, ':') IN (0, length(_url_user)) THEN concat({word}, '@')"
            f" ELSE concat({word}, ':', {secret}, '@') END"
        ),
    })
    df = df.withColumn("_url_path", resolve_dots("_url_path"))
    default_port = F.when(c("_url_scheme") == "https", F.lit("443")).otherwise(F.lit("80"))
    port_ok = (F.length(c("_url_port")) <= 5) & (F.coalesce(c("_url_port").try_cast("int"), F.lit(0)) <= 65535)
    usable = (c("_url_scheme") != "") & (c("_url_final_host") != "") & port_ok
    df = df.withColumn(out, F.when(usable, F.concat(
        c("_url_scheme"), F.lit("://"), c("_url_user"), c("_url_final_host"),
        F.when((c("_url_port") == "") | (c("_url_port") == default_port), F.lit("")).otherwise(F.concat(F.lit(":"), c("_url_port"))),
        F.regexp_replace(c("_url_path"), r"(?<=.)/\z", ""),
        F.when(c("_url_query") == "", F.lit("")).otherwise(F.concat(F.lit("?"), c("_url_query"))),
    )))
    return df.withColumn(raw_out, F.when(c(out).isNotNull(), c("_url_link"))).drop(*_TEMPORARY)
