"""Format-preserving pseudonyms for personal data; DataFrame and SQL functions only.

Values are found by one pattern, validated, and permuted within their own format by a keyed
Feistel network, so equal values have equal pseudonyms in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The production key; a deployment passes its own.
KEY = "pathweave"
ROUNDS = 8
#: Dates of these 73,049 days are permuted among themselves, by a network over 271 x 270.
FIRST_DAY, DAYS, DAY_SIDES = "1900-01-01", 73049, (271, 270)

#: Patterns by kind; the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_date": r"(?<![0-9./])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
PATTERNS["month_date"] = PATTERNS["day_date"]
KINDS = list(PATTERNS)
#: Runs that may hold IBANs and cards next to other words and numbers, where a value may start
#: in them, and its least and largest length with separators.
RUNS = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]++)++(?![a-z])", "[A-Z]{2}[0-9]{2}", 12, 42),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+", "[0-9]", 13, 37),
}

_MARK, _ESCAPE = "\u0001", "\u0002"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(key: str, parts: str) -> str:
    """SQL of a keyed 48-bit number of ``parts`` (SQL strings, comma-separated)."""
    return f"cast(conv(substr(sha2(concat_ws('|', {_quote(key)}, {parts}), 256), 1, 12), 16, 10) AS bigint)"


def _shift(half: str, other: str, key: str, step: str) -> str:
    """SQL of ``half`` with every digit and letter moved on within its class, by amounts drawn
    from ``other``."""
    move = _number(key, f"{step}, {other}, i")
    rotate = lambda alphabet: f"substr('{alphabet}', cast(pmod(instr('{alphabet}', c) - 1 + {move}, {len(alphabet)}) AS int) + 1, 1)"
    one = f"""transform(array(substr({half}, i, 1)), c -> CASE WHEN c BETWEEN '0' AND '9' THEN {rotate("0123456789")}
        WHEN c BETWEEN 'a' AND 'z' THEN {rotate(_LOWER)} WHEN c BETWEEN 'A' AND 'Z' THEN {rotate(_UPPER)} ELSE c END)[0]"""
    return f"IF(length({half}) = 0, '', array_join(transform(sequence(1, length({half})), i -> {one}), ''))"


def permute_string(value: str, key: str) -> str:
    """SQL of a permutation of the strings that have ``value``'s characters' classes.

    The halves move each other on in turn.
    """
    middle = f"cast(ceil(length({value}) / 2) AS int)"
    step = f"""(h, r) -> IF(r % 2 = 1, named_struct('a', {_shift("h.a", "h.b", key, "r")}, 'b', h.b),
        named_struct('a', h.a, 'b', {_shift("h.b", "h.a", key, "r")}))"""
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substr({value}, 1, {middle}), 'b', substr({value}, {middle} + 1)), {step}, h -> concat(h.a, h.b))"


def permute_number(value: str, sides: tuple[int, int], key: str) -> str:
    """SQL of a permutation of 0 <= ``value`` < the product of ``sides``."""
    m, n = sides
    step = f"""(h, r) -> IF(r % 2 = 1, named_struct('a', pmod(h.a + {_number(key, "r, h.b")}, {m}L), 'b', h.b),
        named_struct('a', h.a, 'b', pmod(h.b + {_number(key, "r, h.a")}, {n}L)))"""
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', ({value}) div {n}L, 'b', ({value}) % {n}L), {step}, h -> h.a * {n}L + h.b)"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _refill(value: str, digits: str) -> str:
    """SQL of ``value`` with its digits replaced, in order, by those of ``digits``."""
    spot = f"substr(d, length({_digits(f'substr({value}, 1, j)')}), 1)"
    return f"""transform(array({digits}), d -> array_join(transform(sequence(1, length({value})),
        j -> IF(substr({value}, j, 1) BETWEEN '0' AND '9', {spot}, substr({value}, j, 1))), ''))[0]"""


def _luhn_sum(digits: str, from_right: int) -> str:
    """SQL of the Luhn sum; ``from_right`` is the place of the last digit counted from the check digit."""
    term = f"cast(substr(reverse({digits}), q, 1) AS int) * (1 + (q + {from_right} - 1) % 2)"
    return f"aggregate(sequence(1, length({digits})), 0, (z, q) -> z + ({term}) - IF(({term}) > 9, 9, 0))"


def _card(value: str, key: str) -> str:
    """Digits but the check digit are permuted, and the check digit is made anew."""
    body = f"substr(x, 1, length(x) - 1)"  # noqa: F541
    new = f"transform(array({permute_string(body, key)}), y -> concat(y, cast(pmod(-({_luhn_sum('y', 1)}), 10) AS string)))[0]"
    return f"transform(array({_digits(value)}), x -> {new})[0]"


def _mod97(text: str) -> str:
    """SQL of the remainder by 97 of ``text``, its letters read as 10 to 35."""
    one = f"substr({text}, q, 1)"
    return f"""aggregate(sequence(1, length({text})), 0, (z, q) -> IF({one} BETWEEN '0' AND '9', (z * 10 + cast({one} AS int)) % 97,
        (z * 100 + ascii({one}) - 55) % 97))"""


def _iban(value: str, key: str) -> str:
    """The account's characters are permuted within their class; the check digits follow."""
    body = permute_string("substr(x, 5)", key)
    check = _mod97("concat(y, substr(x, 1, 2), '00')")
    new = f"transform(array({body}), y -> concat(substr(x, 1, 2), lpad(cast(98 - {check} AS string), 2, '0'), y))[0]"
    plain = f"transform(array(replace({value}, ' ', '')), x -> {new})[0]"
    spot = f"substr(d, length(replace(substr({value}, 1, j), ' ', '')), 1)"
    return f"transform(array({plain}), d -> array_join(transform(sequence(1, length({value})), j -> IF(substr({value}, j, 1) = ' ', ' ', {spot})), ''))[0]"


def _date(value: str, year: str, month: str, day: str, key: str, back: str, among: str = "true") -> str:
    """A date of the range as another one, in the same format; days out of range or not ``among``
    (SQL of w) walk on."""
    days = f"datediff(try_to_timestamp(concat_ws('-', {year}, {month}, {day}), 'yyyy-MM-dd'), DATE'{FIRST_DAY}')"
    walk = f"aggregate(sequence(1, 64), {permute_number(f'cast({days} AS bigint)', DAY_SIDES, key)}, (w, q) -> IF(w < {DAYS} AND {among}, w, {permute_number('w', DAY_SIDES, key)}))"
    return f"transform(array(date_add(DATE'{FIRST_DAY}', cast({walk} AS int))), x -> {back})[0]"


def _octets(value: str) -> str:
    return f"split({value}, '[.]')"


def _ssn_ok(value: str) -> str:
    return f"(substr({value}, 1, 3) NOT IN ('000', '666') AND substr({value}, 1, 1) != '9' AND substr({value}, 5, 2) != '00' AND substr({value}, 8) != '0000')"


def _iban_ok(value: str) -> str:
    iban = f"replace({value}, ' ', '')"
    return f"length({iban}) BETWEEN 15 AND 34 AND transform(array({iban}), x -> {_mod97('concat(substr(x, 5), substr(x, 1, 4))')})[0] = 1"


def _card_ok(value: str) -> str:
    return f"transform(array({_digits(value)}), x -> {_luhn_sum('x', 0)})[0] % 10 = 0"


def _kinds(value: str) -> str:
    """SQL of the kind of a match, null if it is not valid."""
    whole = lambda k: f"regexp_like({value}, {_quote('^(?:' + PATTERNS[k] + ')$')})"
    in_range = lambda y, m, d: f"coalesce(datediff(try_to_timestamp(concat_ws('-', {y}, {m}, {d}), 'yyyy-MM-dd'), DATE'{FIRST_DAY}') BETWEEN 0 AND {DAYS - 1}, false)"
    part = lambda a, n: f"substr({value}, {a}, {n})"
    valid = {
        "email": "true",
        "iso_date": in_range(part(1, 4), part(6, 2), part(9, 2)),
        "day_date": in_range(part(7, 4), part(4, 2), part(1, 2)),
        "month_date": in_range(part(7, 4), part(1, 2), part(4, 2)),
        "ip": f"forall({_octets(value)}, o -> cast(o AS int) <= 255)",
        "ssn": _ssn_ok(value),
        "phone": "true",
        "iban": _iban_ok(value),
        "card": _card_ok(value),
    }
    return "CASE " + " ".join(f"WHEN {whole(k)} AND {valid[k]} THEN '{k}'" for k in KINDS) + " END"


def _scan(run: str, kind: str) -> str:
    """SQL of a run with marks around the valid values of ``kind`` in it: from the left, the
    longest one at each place, made of whole groups of characters."""
    _, start, least, most = RUNS[kind]
    ok = {"iban": _iban_ok, "card": _card_ok}[kind]("y")
    cut = lambda a, b: f"substr({run}, {a}, {b})"
    begins = f"(i = 1 OR NOT regexp_like({cut('i - 1', 1)}, '[A-Z0-9]')) AND regexp_like({cut('i', 4)}, '^{start}')"
    whole = f"regexp_like(y, {_quote('^(?:' + PATTERNS[kind] + ')$')})"
    fits = f"NOT regexp_like({cut('e + 1', 1)}, '[A-Z0-9]') AND exists(array({cut('i', 'e - i + 1')}), y -> {whole} AND {ok})"
    ends = f"filter(reverse(sequence(i + {least - 1}, least(i + {most - 1}, length({run})))), e -> {fits})"
    found = f"IF(i < acc.at OR i + {least - 1} > length({run}), 0, IF({begins}, coalesce(get({ends}, 0), 0), 0))"
    step = f"""transform(array({found}), e -> IF(e = 0, acc, named_struct('at', e + 1,
        'out', concat(acc.out, {cut('acc.at', 'i - acc.at')}, '{_MARK}', {cut('i', 'e - i + 1')}, '{_MARK}'))))[0]"""
    return f"aggregate(sequence(1, length({run})), named_struct('at', 1, 'out', ''), (acc, i) -> {step}, acc -> concat(acc.out, {cut('acc.at', f'length({run})')}))"


def _marked_runs(text: str, kind: str) -> str:
    """SQL of a marked text with marks around the values of ``kind`` outside of marked ones."""
    runs = f"split(regexp_replace(v, {_quote(RUNS[kind][0])}, '{_MARK}$0{_MARK}'), '{_MARK}', -1)"
    plain = f"array_join(transform({runs}, (r, j) -> IF(j % 2 = 1, {_scan('r', kind)}, r)), '')"
    return f"array_join(transform(split({text}, '{_MARK}', -1), (v, i) -> IF(i % 2 = 1, concat('{_MARK}', v, '{_MARK}'), {plain})), '')"


def pseudonym(value: str, kind: str, key: str = KEY) -> str:
    """SQL of the pseudonym of a valid ``value`` of ``kind`` (both SQL)."""
    octet = lambda i: f"cast({_octets(value)}[{i}] AS bigint)"
    address = f"(({octet(0)} * 256 + {octet(1)}) * 256 + {octet(2)}) * 256 + {octet(3)}"
    ip = f"transform(array({permute_number(address, (65536, 65536), key + 'ip')}), x -> concat_ws('.', x div 16777216, x div 65536 % 256, x div 256 % 256, x % 256))[0]"
    ssn = f"aggregate(sequence(1, 64), {permute_string(value, key + 'ssn')}, (w, q) -> IF({_ssn_ok('w')}, w, {permute_string('w', key + 'ssn')}))"
    country = f"regexp_extract({value}, '^[+][0-9]{{1,3}}', 0)"
    national = f"substr({value}, length({country}) + 1)"
    made = {
        "email": f"concat({permute_string(f'''substring_index({value}, '@', 1)''', key + 'email')}, '@', substring_index({value}, '@', -1))",
        "iso_date": _date(value, f"substr({value}, 1, 4)", f"substr({value}, 6, 2)", f"substr({value}, 9, 2)", key + "date", "date_format(x, 'yyyy-MM-dd')"),
        "day_date": _date(value, f"substr({value}, 7, 4)", f"substr({value}, 4, 2)", f"substr({value}, 1, 2)", key + "date", f"concat(date_format(x, 'dd'), substr({value}, 3, 1), date_format(x, 'MM'), substr({value}, 6, 1), date_format(x, 'yyyy'))"),
        # days up to 12 are read as dd/mm, so they are not among these
        "month_date": _date(value, f"substr({value}, 7, 4)", f"substr({value}, 1, 2)", f"substr({value}, 4, 2)", key + "date", f"concat(date_format(x, 'MM'), substr({value}, 3, 1), date_format(x, 'dd'), substr({value}, 6, 1), date_format(x, 'yyyy'))", f"day(date_add(DATE'{FIRST_DAY}', cast(w AS int))) > 12"),
        "ip": ip,
        "ssn": ssn,
        "phone": f"concat({country}, {_refill(national, permute_string(_digits(national), key + 'phone'))})",
        "iban": _iban(value, key + "iban"),
        "card": _refill(value, _card(value, key + "card")),
    }
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {made[k]}" for k in KINDS) + f" ELSE {value} END"


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``_row`` (a struct of the row's columns but ``text``, whatever their names), ``text`` with
    every valid value replaced, and ``found``, an array of (kind, original place, pseudonym).

    Emails keep their domain, phone numbers their country code, IBANs their country; card
    numbers and IBANs stay valid, dates stay dates between 1900 and 2099.  Numbers that fail
    validation are left alone, as are all other characters.  Formats of one number (spaces or
    dashes) share a pseudonym.  IBANs and cards are sought in what the other kinds leave, at
    each group of characters and in each length, so a value next to other numbers or words is
    found; dates are read as dd/mm, else as mm/dd.  Null texts stay null and have nothing; empty texts stay
    empty; repeated rows are treated alike; an empty table gives an empty result.
    """
    every = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k not in RUNS)
    text = F.col("_text")
    safe = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK), F.lit(_ESCAPE + "a"))
    # most texts hold neither two digits in a row nor an at sign, and skip the rest
    marked = F.when(text.rlike("[0-9][0-9 .()/-]?[0-9]|@"), F.regexp_replace(safe, every, f"{_MARK}$0{_MARK}"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), F.col("text").cast("string").alias("_text"))
    # matches that are not valid become plain text again
    valid = f"array_join(transform(split(_marked, '{_MARK}', -1), (v, i) -> IF(i % 2 = 1 AND {_kinds('v')} IS NOT NULL, concat('{_MARK}', v, '{_MARK}'), v)), '')"
    rows = rows.withColumn("_marked", marked).withColumn("_marked", F.when(F.instr("_marked", _MARK) > 0, F.expr(valid)).otherwise(F.col("_marked")))
    for kind, (pattern, *_) in RUNS.items():
        rows = rows.withColumn("_marked", F.when(F.col("_marked").rlike(pattern), F.expr(_marked_runs("_marked", kind))).otherwise(F.col("_marked")))
    pieces = F.split("_marked", _MARK, -1)
    rows = rows.withColumn("_pieces", F.when(F.size(pieces) > 1, pieces))
    kinds = F.expr(f"transform(_pieces, (v, i) -> IF(i % 2 = 1, {_kinds('v')}, NULL))")
    rows = rows.withColumn("_kinds", F.when(F.col("_pieces").isNotNull(), kinds))
    rows = rows.withColumn("_new", F.when(F.col("_pieces").isNotNull(), F.expr(f"zip_with(_pieces, _kinds, (v, k) -> IF(k IS NULL, v, {pseudonym('v', 'k', key)}))")))
    joined = F.array_join("_new", "")
    plain = F.replace(F.replace(joined, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))
    places = "aggregate(slice(_pieces, 1, i), 0, (z, p) -> z + length(p))"
    found = F.expr(f"filter(transform(_kinds, (k, i) -> IF(k IS NULL, NULL, named_struct('kind', k, 'start', {places.replace('slice(_pieces, 1, i)', 'slice(_pieces, 1, i)')}, 'pseudonym', _new[i]))), f -> f IS NOT NULL)")
    return rows.select("_row", F.coalesce(plain, text).alias("text"), F.coalesce(found, F.expr("cast(array() AS array<struct<kind: string, start: int, pseudonym: string>>)")).alias("found"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda *kinds: F.size(F.filter("found", lambda f: f["kind"].isin(*kinds))).cast("long")
    return out.select(
        F.col("_row.doc_id").alias("doc_id"), "text", F.size("found").cast("long").alias("n_values"),
        *[count(k).alias(f"n_{k}") for k in ("email", "ip", "ssn", "phone", "iban", "card")], count("iso_date", "day_date", "month_date").alias("n_date"),
        F.array_join(F.transform("found", lambda f: f["pseudonym"]), ", ").alias("pseudonyms"),
    )


def has_kind(found: Column, kind: str) -> Column:
    """Whether an array of findings holds a kind."""
    return F.exists(found, lambda f: f["kind"] == kind)
