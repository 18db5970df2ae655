"""Format-preserving Feistel pseudonyms for personal data.

One pattern finds candidates; each is validated by its kind (Luhn, calendar, octets, mod 97 at the country's length, areas and
groups in use). A valid value is permuted by a keyed Feistel network within its own format: digits stay digits, letters letters,
separators stay, and what was valid stays valid. A value has the same pseudonym in every document, and different values of a kind
and format never share one: where only some texts of a format are valid, the network walks on until it is among them again.
Rounds are keyed by SHA-256 over key, kind, round and the other half. Everything is DataFrame expressions.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

ROUNDS = 6
#: Groups of digits that are looked through at once for card numbers.
GROUPS = 32
# Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
# Telephone country codes of one and two digits; all others have three.
CALLING_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Beginnings of keys that stay, so that a key is still known as one.
KEY_STARTS = r"AKIA|ASIA|gh[oprsu]_|github_pat_|sk-|[prs]k_live_|xox[abprs]-|AIza|eyJ"
_IBANS = "|".join(rf"(?:{'|'.join(codes.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
_FOURS = r"\d{4}(?:[ -]\d{4}(?![-/.]\d{1,2}(?!\d))){3,}(?:[ -]\d{1,3}(?![\d/]|[.-]\d))?"
_APART, _END = r"(?<![A-Za-z0-9])(?<!\d[.,])", r"(?![A-Za-z0-9])"
#: Kinds in the order in which they are tried at a place of the text.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=,:\s-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    # In quotes any word, after a bare equals sign too; elsewhere a word with a digit, so that prose stays.
    "secret": r"(?i:(?<![A-Za-z0-9])(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)[\"']?(?:\s{0,3}[=:]\s{0,3}(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|(?=[A-Za-z0-9_/+-]*[0-9])[A-Za-z0-9_/+-]{6,})|=[A-Za-z0-9_/+-]{6,}))",
    "key_id": rf"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[oprsu]_[A-Za-z0-9]{{36,}}|github_pat_[A-Za-z0-9_]{{22,}}|sk-[A-Za-z0-9_-]{{20,}}|[prs]k_live_[A-Za-z0-9]{{16,}}|xox[abprs]-[A-Za-z0-9-]{{10,}}|AIza[A-Za-z0-9_-]{{35}}|eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}){_END}",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{_IBANS}){_END}",
    "ip6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "phone": r"(?<![\w+])\+?\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": rf"{_APART}(?:{_FOURS}|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}|\d{{13,19}}){_END}",
}
#: The kinds that begin with a letter, and those that begin with a digit, sign or bracket, are tried at such places only.
_WORDS, _NUMBERS = ("|".join(f"(?:{PATTERNS[k]})" for k in kinds) for kinds in (("email", "secret", "key_id", "iban", "ip6"), ("ip", "date", "phone", "ssn", "card")))
ANY = rf"{PATTERNS['private_key']}|(?<![A-Za-z0-9])(?:{_WORDS})|(?=[0-9+(])(?:{_NUMBERS})"
_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
_DAYS = (_LAST_DAY - _FIRST_DAY).days + 1
#: Steps of a walk back among valid texts. No step is outside with a chance of more than about 0.4, so all of them with one below 1e-25.
STEPS = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def walked(value: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """step(value), step again until valid: a permutation of the valid values if step is one of them all."""
    last = F.aggregate(F.array_repeat(F.lit(0), STEPS), step(value), lambda x, _: F.when(valid(x), x).otherwise(step(x)))
    return let(last, lambda x: F.when(valid(x), x).otherwise(F.raise_error(F.lit("a value did not walk back among the valid ones")).cast("string")))


def _stream(secret: str, tweak: Column, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), tweak, turn.cast("string"), half), 256)


def _shifted(half: Column, stream: Column, hexadecimal: bool, back: bool) -> Column:
    """half with each letter and digit moved within its alphabet by its byte of the stream (reused after 32)."""

    def moved(bytes_of: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substr(bytes_of, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int") * (-1 if back else 1)

            def within(alphabet: str, otherwise: Column) -> Column:
                at = F.call_function("instr", F.lit(alphabet), c)
                return F.when(at > 0, F.substr(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(otherwise)

            return within(_HEX, c) if hexadecimal else within(_DIGITS, within(_LOWER, within(_UPPER, c)))

        return F.array_join(F.transform(F.split(half, ""), one), "")

    return let(stream, moved)


def feistel_text(value: Column, secret: str, kind: str, hexadecimal: bool = False, back: bool = False) -> Column:
    """value permuted (or with back, restored) among the texts of its format; under two characters it stays.

    With hexadecimal the letters a to f are digits too.
    """

    def network(v: Column) -> Column:
        cut = F.call_function("div", F.length(v), F.lit(2)).cast("int")
        start = F.struct(F.substr(v, F.lit(1), cut).alias("l"), F.substr(v, cut + 1).alias("r"))
        tweak = F.concat(F.lit(kind + ":"), F.length(v).cast("string"))

        def turn(at: Column, i: Column) -> Column:
            left, right = at["l"], at["r"]
            return F.struct(
                F.when(i % 2 == 0, _shifted(left, _stream(secret, tweak, i, right), hexadecimal, back)).otherwise(left).alias("l"),
                F.when(i % 2 == 0, right).otherwise(_shifted(right, _stream(secret, tweak, i, left), hexadecimal, back)).alias("r"),
            )

        turns = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
        return F.when(F.length(v) < 2, v).otherwise(F.aggregate(turns, start, turn, lambda at: F.concat(at["l"], at["r"])))

    return let(value, network)


def feistel_number(number: Column, size: int, secret: str, kind: str) -> Column:
    """number (0 to size - 1) permuted in that range, by cycle walking in a slightly larger rectangle."""
    b = int(size**0.5)
    a = -(-size // b)

    def step(at: Column, i: Column) -> Column:
        move = lambda half: F.conv(F.substr(_stream(secret, F.lit(kind), i, half.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("long")
        return F.struct(
            F.when(i % 2 == 0, F.pmod(at["l"] + move(at["r"]), F.lit(a).cast("long"))).otherwise(at["l"]).alias("l"),
            F.when(i % 2 == 0, at["r"]).otherwise(F.pmod(at["r"] + move(at["l"]), F.lit(b).cast("long"))).alias("r"),
        )

    def walk(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda at: at["l"] * b + at["r"])

    if a * b == size:
        return let(number, walk)
    # Numbers beyond the range are fewer than a; 16 steps all ending there have a chance below 1e-30.
    last = F.aggregate(F.sequence(F.lit(1), F.lit(min(16, a * b - size))), let(number, walk), lambda x, _: F.when(x < size, x).otherwise(walk(x)))
    return let(last, lambda x: F.when(x < size, x).otherwise(F.raise_error(F.lit("a number did not walk back into range")).cast("long")))


def with_digits(value: Column, digits: Column, kept: str = "^[^0-9]$") -> Column:
    """value with its digits (or what does not match `kept`) replaced, one after the other, by those of `digits`."""

    def fill(new: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

        def put(at: Column, c: Column) -> Column:
            stays = c.rlike(kept)
            return F.struct(F.concat(at["out"], F.when(stays, c).otherwise(F.substr(new, at["next"], F.lit(1)))).alias("out"), (at["next"] + F.when(stays, 0).otherwise(1)).alias("next"))

        return F.aggregate(F.split(value, ""), start, put, lambda at: at["out"])

    return let(digits, fill)


def luhn_sum(digits: Column) -> Column:
    """Sum over digits, every second from the right end doubled and reduced."""
    one = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.call_function("div", c.cast("int") * 2, F.lit(10)).cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN (first four characters moved to the end, letters as 10 to 35)."""
    turned = F.split(F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4))), "")
    value = lambda c: F.call_function("instr", F.lit(_DIGITS + _UPPER), c) - 1
    return F.aggregate(turned, F.lit(0), lambda a, c: F.pmod(F.when(value(c) < 10, a * 10).otherwise(a * 100) + value(c), F.lit(97)))


def _valid_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (F.pmod(luhn_sum(digits), F.lit(10)) == 0)


def _card(value: Column, secret: str) -> Column:
    """All digits but the last are permuted, which makes the sum right again."""

    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))

    digits = F.regexp_replace(value, "[^0-9]", "")
    new = let(feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), secret, "card"), checked)
    return F.when(_valid_card(digits), with_digits(value, new))


def _cards(value: Column, secret: str) -> Column:
    """array(struct(old, kind, new)) of groups of four digits: a card number may begin at each group and have up to three digits more."""

    def scan(groups: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            def tried(count: int) -> Column:
                own = [F.get(groups, i + j) for j in range(count)]  # a slice would go through all groups
                part = F.concat(*own)  # null beyond the end
                fits = part.isNotNull() & F.forall(F.array(*own[:4]), lambda g: F.length(F.regexp_replace(g, "[ -]", "")) == 4)
                return F.when(fits, F.when(_valid_card(F.regexp_replace(part, "[^0-9]", "")), part))

            def go_on(found: Column) -> Column:
                used = F.when(F.length(F.regexp_replace(found, "[^0-9]", "")) > 16, 5).otherwise(4)
                # The separator before a number stays before it.
                lead = F.regexp_extract(found, "^[ -]?", 0)
                bare = F.regexp_replace(found, "^[ -]", "")
                hit = F.array(F.struct(lead.alias("old"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new")), F.struct(bare.alias("old"), F.lit("card").alias("kind"), _card(bare, secret).alias("new")))
                miss = F.array(F.struct(F.get(groups, i).alias("old"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new")))
                return F.struct(F.concat(state["done"], F.when(found.isNotNull(), hit).otherwise(miss)).alias("done"), F.when(found.isNotNull(), i + used).otherwise(i + 1).cast("int").alias("next"))

            return F.when(i < state["next"], state).otherwise(let(F.coalesce(tried(5), tried(4)), go_on))

        # Each step copies what its block has done so far, and each block the list of blocks: linear up to millions of groups.
        none = F.array().cast("array<struct<old:string,kind:string,new:string>>")

        def block(state: Column, first: Column) -> Column:
            put = lambda made: F.struct(F.concat(state["done"], F.array(made["done"])).alias("done"), made["next"].alias("next"))
            own = F.sequence(first, F.least(first + GROUPS, F.size(groups)) - 1)
            return F.aggregate(own, F.struct(none.alias("done"), state["next"].alias("next")), step, put)

        start = F.struct(F.array().cast("array<array<struct<old:string,kind:string,new:string>>>").alias("done"), F.lit(0).alias("next"))
        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1, F.lit(GROUPS)), start, block, lambda x: F.flatten(x["done"]))

    return let(F.regexp_extract_all(value, F.lit("[ -]?[0-9]+"), F.lit(0)), scan)


def _iban(value: Column, secret: str) -> Column:
    """The account part is permuted, the check digits are made anew, spaces stay."""
    packed = F.replace(value, F.lit(" "), F.lit(""))
    country = F.substr(packed, F.lit(1), F.lit(2))

    def checked(account: Column) -> Column:
        return F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)

    new = let(feistel_text(F.substr(packed, F.lit(5)), secret, "iban"), checked)
    return F.when(_mod97(packed) == 1, with_digits(value, new, "^ $"))


def _ip(value: Column, secret: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)

    def dotted(new: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.shiftright(new, shift), F.lit(256)).cast("string") for shift in (24, 16, 8, 0)])

    return F.when(F.forall(octets, lambda x: x < 256), let(feistel_number(number, 1 << 32, secret, "ip"), dotted))


def _like(value: Column, new: Column) -> Column:
    """new in the upper and lower case of value, character by character."""
    return F.array_join(F.zip_with(F.split(value, ""), F.split(new, ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")


def _ip6(value: Column, secret: str) -> Column:
    """Hexadecimal digits are permuted, colons stay; numbers need not keep their case."""
    digits = F.replace(F.lower(value), F.lit(":"), F.lit(""))
    new = with_digits(F.lower(value), feistel_text(digits, secret, "ip6", True), "^:$")
    return F.when(value.rlike("[0-9]"), F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new))


def _date(value: Column, secret: str) -> Column:
    """ISO dates, and slashed ones read as day first or, where that is no date, month first; years 1900 to 2099.

    Each of the three kinds of texts is permuted within itself: month first means a day after the 12th.
    """

    def of(form: str, name: str, late: bool = False) -> Column:
        day = F.try_to_timestamp(value, F.lit(form)).cast("date")
        number = F.datediff(day, F.lit(_FIRST_DAY.isoformat()).cast("date")).cast("long")
        step = lambda d: F.date_format(F.date_add(F.lit(_FIRST_DAY.isoformat()).cast("date"), feistel_number(d, _DAYS, secret, name).cast("int")), form)
        again = lambda text: step(F.datediff(F.to_date(text, form), F.lit(_FIRST_DAY.isoformat()).cast("date")).cast("long"))
        new = step(number) if not late else walked(F.date_format(day, form), again, lambda text: F.substr(text, F.lit(4), F.lit(2)) > "12")
        return F.when(number.between(0, _DAYS - 1), new)

    return F.when(F.contains(value, F.lit("-")), of("yyyy-MM-dd", "date")).otherwise(F.coalesce(of("dd/MM/yyyy", "day first"), of("MM/dd/yyyy", "month first", True)))


def _phone(value: Column, secret: str) -> Column:
    """A country code with a plus sign stays, of 8 to 15 digits all others are permuted. Without one there are 10 or 11 digits, and an
    area begins with 2 to 9 before and after."""
    code = F.regexp_extract(value, CALLING_CODE, 0)
    rest = F.substr(value, F.length(code) + 1)
    digits = F.regexp_replace(rest, "[^0-9]", "")
    abroad = F.when(F.length(digits) + F.length(code) - 1 <= 15, F.when(F.length(digits) + F.length(code) - 1 >= 8, F.concat(code, with_digits(rest, feistel_text(digits, secret, "phone")))))
    lead = F.substr(digits, F.lit(1), F.length(digits) - 10)
    number = (F.substr(digits, F.length(digits) - 9).cast("long") - 2_000_000_000)
    home = let(feistel_number(number, 8_000_000_000, secret, "area"), lambda x: with_digits(value, F.concat(lead, (x + 2_000_000_000).cast("string"))))
    return F.when(F.length(code) > 0, abroad).when(F.length(digits).between(10, 13) & (number >= 0), home)


def _secret(value: Column, secret: str) -> Column:
    """The word after the sign. Hexadecimal words stay so, others don't become so."""
    start = F.regexp_extract(value, r"^[A-Za-z_-]+[\"']?\s*[=:]\s*[\"']?", 0)
    end = F.regexp_extract(value, "[\"']?$", 0)
    word = F.substr(value, F.length(start) + 1, F.length(value) - F.length(start) - F.length(end))

    def hexadecimal(x: Column) -> Column:
        return x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & x.rlike("[0-9]") & x.rlike("[A-Fa-f]")

    hexes = lambda x: walked(x, lambda v: feistel_text(v, secret, "hex", True), hexadecimal)
    others = walked(word, lambda v: feistel_text(v, secret, "secret"), lambda x: ~hexadecimal(x))
    return F.concat(start, F.when(~hexadecimal(word), others).when(word.rlike("[A-F]"), F.upper(hexes(F.lower(word)))).otherwise(hexes(word)), end)


def _email(value: Column, secret: str) -> Column:
    """All but the last label of the domain; case is kept but makes no other address."""
    end = F.regexp_extract(value, r"\.[A-Za-z0-9-]+$", 0)
    own = F.substr(value, F.lit(1), F.length(value) - F.length(end))
    return F.concat(_like(own, feistel_text(F.lower(own), secret, "email")), end)


def _ssn(value: Column, secret: str) -> Column:
    """Areas but 000, 666 and 900 on, groups and serials but zero."""
    area, group, serial = F.substr(value, F.lit(1), F.lit(3)).cast("long"), F.substr(value, F.lit(5), F.lit(2)).cast("long"), F.substr(value, F.lit(8), F.lit(4)).cast("long")
    number = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1

    def spelt(x: Column) -> Column:
        top = F.call_function("div", x, F.lit(99 * 9999).cast("long"))
        parts = (top + 1 + (top >= 665).cast("long"), 3), (F.pmod(F.call_function("div", x, F.lit(9999).cast("long")), F.lit(99).cast("long")) + 1, 2), (F.pmod(x, F.lit(9999).cast("long")) + 1, 4)
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), let(feistel_number(number, 898 * 99 * 9999, secret, "ssn"), spelt))


def _key_id(value: Column, secret: str) -> Column:
    start = F.regexp_extract(value, f"^(?:{KEY_STARTS})", 0)
    return F.concat(start, feistel_text(F.substr(value, F.length(start) + 1), secret, "key_id"))


def _private_key(value: Column, secret: str) -> Column:
    """What is between the first and last line; white space and signs stay."""
    start, end = F.regexp_extract(value, "^-----[A-Z ]+-----", 0), F.regexp_extract(value, "-----[A-Z ]+-----$", 0)
    return F.concat(start, feistel_text(F.substr(value, F.length(start) + 1, F.length(value) - F.length(start) - F.length(end)), secret, "private_key"), end)


_MAKERS = {
    "private_key": _private_key,
    "email": _email,
    "secret": _secret,
    "key_id": _key_id,
    "iban": _iban,
    "ip": _ip,
    "ip6": _ip6,
    "date": _date,
    "phone": _phone,
    "ssn": _ssn,
    "card": _card,
}


def pseudonyms(value: Column, secret: str) -> Column:
    """array(struct(old, kind, new)) of a candidate's parts: new is null where nothing is replaced.

    A candidate is of the first kind whose pattern and validation it passes. Only groups of four digits can have several parts.
    """
    tries = []
    for kind, pattern in PATTERNS.items():
        new = F.when(value.rlike(f"^(?:{pattern})$"), _MAKERS[kind](value, secret))
        tries.append(F.struct(value.alias("old"), F.lit(kind).alias("kind"), new.alias("new")))
    nothing = F.struct(value.alias("old"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new"))
    found = F.array(F.coalesce(F.get(F.filter(F.array(*tries), lambda x: x["new"].isNotNull()), 0), nothing))
    return F.when(value.rlike(f"^(?:{_FOURS})$"), _cards(value, secret)).otherwise(found)


def pseudonymise(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """docs with personal data of `text` replaced, and pii, the list of (kind, new) in order of the text.

    E-mail addresses, secrets, keys, IBANs, IP addresses, dates, phone, social security and card numbers. Candidates that fail
    validation stay as they are. Null text stays null, with an empty list. Rows are independent, so repeated
    rows get the same result; other columns are kept, one named pii is replaced.
    """
    body = text_of(text)
    between, hits = F.split(body, ANY, -1), F.regexp_extract_all(body, F.lit(ANY), F.lit(0))
    plain = lambda x: F.array(F.struct(x.alias("old"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new")))
    made = F.flatten(F.zip_with(between, hits, lambda a, b: F.concat(plain(a), F.when(b.isNotNull(), pseudonyms(b, secret)).otherwise(F.array().cast("array<struct<old:string,kind:string,new:string>>")))))
    # Every kind has a digit, an at sign or an equals or colon; texts without them skip the search.
    found = docs.withColumn("pii found", F.when(body.rlike("[0-9@=:]"), made).otherwise(F.array().cast("array<struct<old:string,kind:string,new:string>>")))
    joined = F.array_join(F.transform("pii found", lambda x: F.coalesce(x["new"], x["old"])), "")
    pii = F.transform(F.filter("pii found", lambda x: x["new"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("new")))
    return found.withColumn(text, F.when(F.size(pii) > 0, joined).otherwise(F.col(text))).withColumn("pii", pii).drop("pii found")
