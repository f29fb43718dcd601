"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by pattern and validated: cards by the Luhn sum, bank accounts
(IBAN) by the remainder of 97, addresses by the range of their parts, social security
numbers by their groups, dates by the calendar, international phone numbers by
country code and length.  What doesn't validate is left alone.  A validated value is
encoded as a whole number, run through a keyed Feistel network over exactly the
numbers of its format, and decoded in the same format: digits stay where digits were,
a card and an account keep right check digits, a date stays a date in its own order.
Equal values get equal pseudonyms in all documents, different values different ones,
and whoever has the key can go back.

The network is an alternating one over Z_a x Z_b for any a and b, so no value
falls outside its format and there is no retrying.  Round values come from
SHA-256 of key, kind, round and half.

Slashed dates are day first where that is a date, else month first; the latter are
permuted among the dates that can only be read so, by walking the network's cycle.
Numbers of over 18 digits go through in two parts, each keyed by the other.
Hexadecimal secrets are permuted in blocks of 12 digits.  Mail addresses keep their
domain and get a keyed tag of 128 bits for the name before it (no permutation: it
cannot be undone).

Everything happens within a row; there is no shuffle.  Null texts stay null, empty
ones empty; texts of any length are treated whole.  Where patterns overlap the
leftmost match counts, then their order here.  Repeated rows are each treated alike;
an empty table gives no rows; other columns pass.  Dates outside 1800 to 2199, dates
without leading zeros and national numbers not written 3-3-4 are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import bind, whole_row

ROUNDS = 10
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
#: Country calling codes of one, two and three digits.
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689]\d|3[578]\d|42\d|5[09]\d|6[789]\d|8[0578]\d|9[679]\d)"
ABROAD = rf"(?<![\d+])\+{COUNTRY}(?:[ .-]?(?:\(\d{{1,4}}\)|\d)){{6,12}}(?!\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)"
ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
PATTERN = "|".join((MAIL, HEX, ADDRESS, DATE, SOCIAL, PHONE, ABROAD, CARD, ACCOUNT))
KINDS = ("mail", "secret", "address", "date", "social", "phone", "card", "account")
TENS = [10**k for k in range(19)]
#: Days from 1800-01-01 to 2199-12-31: 400 years of the calendar are 189 * 773 days.
FIRST_DAY, DAY_A, DAY_B = "1800-01-01", 189, 773
#: Steps after which a walk has ended: one in 10 ** 24 of all values would need more.
WALK = 60


def digits_of(text: Column) -> Column:
    return F.translate(text, " .-/()+", "")


def keyed(key: str, kind: str | Column, number: Column, half: Column) -> Column:
    """60 bits of SHA-256 as a whole number."""
    raw = F.sha2(F.concat_ws("|", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), number, half), 256)
    return F.conv(F.substring(raw, 1, 15), 16, 10).cast("long")


def feistel(x: Column, a: Column, b: Column, key: str, kind: str | Column, back: bool = False) -> Column:
    """The keyed permutation of 0 .. a * b - 1 at `x`; `back`: its inverse."""

    def turn(s: Column, k: Column) -> Column:
        k = F.lit(ROUNDS - 1) - k if back else k
        move_left = F.pmod(keyed(key, kind, k, s["right"]), a)
        move_right = F.pmod(keyed(key, kind, k, s["left"]), b)
        left, right = (s["left"] - move_left, s["right"] - move_right) if back else (s["left"] + move_left, s["right"] + move_right)
        even = k % 2 == 0
        return F.struct(F.when(even, F.pmod(left, a)).otherwise(s["left"]).alias("left"), F.when(even, s["right"]).otherwise(F.pmod(right, b)).alias("right"))

    right = F.pmod(x, b)
    start = F.struct(F.call_function("div", x - right, b).alias("left"), right.alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["left"] * b + s["right"])


def permute_digits(digits: Column, key: str, kind: str | Column, back: bool = False) -> Column:
    """A string of 1 to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    tens = F.array(*[F.lit(t).cast("long") for t in TENS])
    half = F.floor(n / 2).cast("int")

    def halves(v: Column) -> Column:
        return F.lpad(v.cast("string"), n, "0")

    return bind(feistel(digits.cast("long"), F.get(tens, half), F.get(tens, n - half), key, kind, back), halves)


def permute_long(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A string of any number of digits: what is beyond 18 keys the rest, then is keyed by it, and keys it again."""

    def turn(s: Column, number: int) -> Column:
        moves, other = ("low", "high") if number == 1 else ("high", "low")
        changed = {moves: permute_digits(s[moves], key, F.concat_ws("|", F.lit(f"{kind}{number}"), s[other]), back), other: s[other]}
        return F.struct(changed["high"].alias("high"), changed["low"].alias("low"))

    def all_turns(s: Column, numbers: list[int]) -> Column:
        return bind(turn(s, numbers[0]), lambda t: all_turns(t, numbers[1:])) if numbers else F.concat(s["high"], s["low"])

    parts = F.struct(F.substring(digits, 1, 18).alias("high"), F.substring(digits, F.lit(19), F.length(digits)).alias("low"))
    long = bind(parts, lambda s: all_turns(s, [2, 1, 0] if back else [0, 1, 2]))
    return F.when(F.length(digits) <= 18, permute_digits(digits, key, kind, back)).otherwise(long)


def put_back(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced by `digits`, one after another."""
    parts = F.split(form, "")
    place = lambda k: F.length(F.regexp_replace(F.substring(form, 1, k), "[^0-9]", ""))
    return F.array_join(F.transform(parts, lambda c, k: F.when(c.rlike("[0-9]"), F.substring(digits, place(k + 1), F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of `digits`, the last of which counts once."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def mail(x: Column, key: str, back: bool) -> Column:
    name, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(name), F.lower(domain)), 256), 1, 32), F.lit("@"), domain)


def secret(x: Column, key: str, back: bool) -> Column:
    n = F.length(x)
    big = F.upper(x) == x

    def block(k: Column) -> Column:
        part = F.substring(x, k * 12 + 1, F.least(F.lit(12), n - k * 12))
        size = F.length(part)
        half = F.floor(size / 2).cast("int")
        sixteens = F.array(*[F.lit(16**j).cast("long") for j in range(13)])
        value = feistel(F.conv(part, 16, 10).cast("long"), F.get(sixteens, half), F.get(sixteens, size - half), key, "secret", back)
        return F.lpad(F.lower(F.hex(value)), size, "0")

    low = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 12).cast("int")), block), "")
    return F.when(big, F.upper(low)).otherwise(low)


def address(x: Column, key: str, back: bool) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))

    def change(p: Column) -> Column:
        value = F.aggregate(p, F.lit(0).cast("long"), lambda a, v: a * 256 + v)
        side = F.lit(1 << 16).cast("long")
        new = feistel(value, side, side, key, "address", back)
        return bind(new, lambda v: F.concat_ws(".", *[F.call_function("div", v, F.lit(256**k).cast("long")) % 256 for k in (3, 2, 1, 0)]))

    return F.when(F.forall(parts, lambda p: p < 256), bind(parts, change))


def date(x: Column, key: str, back: bool) -> Column:
    first, mark = F.lit(FIRST_DAY).cast("date"), x.substr(3, 1)
    forms = {"iso": "yyyy-MM-dd", "dotted": "dd.MM.yyyy", "day": "dd/MM/yyyy", "month": "MM/dd/yyyy"}
    read = {name: F.try_to_date(x, form) for name, form in forms.items()}
    form = F.when(x.substr(5, 1) == "-", "iso").when(mark == ".", "dotted").when(read["day"].isNotNull(), "day").otherwise("month")
    sides = F.lit(DAY_A).cast("long"), F.lit(DAY_B).cast("long")

    def day_of(number: Column) -> Column:
        return F.date_add(first, number.cast("int"))

    def step(number: Column) -> Column:
        return feistel(number, *sides, key, "date", back)

    def walk(number: Column) -> Column:
        """On through the cycle until the date can only be read month first."""
        start = F.struct(step(number).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda s, _: F.when(F.dayofmonth(day_of(s["n"])) > 12, s).otherwise(F.struct(step(s["n"]).alias("n"))), lambda s: s["n"])

    def of(form: Column) -> Column:
        by_form = lambda make: F.when(form == "iso", make("iso")).when(form == "dotted", make("dotted")).when(form == "day", make("day")).otherwise(make("month"))
        number = F.datediff(by_form(lambda name: read[name]), first).cast("long")
        new = bind(number, lambda n: F.when(form == "month", walk(n)).otherwise(step(n)))
        shown = bind(day_of(new), lambda d: by_form(lambda name: F.date_format(d, forms[name])))
        return F.when(number.between(0, DAY_A * DAY_B - 1), shown)

    return bind(form, of)


def social(x: Column, key: str, back: bool) -> Column:
    area, group, serial = (x.substr(*p).cast("long") for p in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    side = F.lit(99 * 9999).cast("long")
    new = feistel(rank * side + (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), side, key, "social", back)

    def shown(v: Column) -> Column:
        r = F.call_function("div", v, side)
        return F.format_string("%03d-%02d-%04d", F.when(r >= 665, r + 2).otherwise(r + 1), F.floor(F.pmod(v, side) / 9999).cast("long") + 1, F.pmod(v, F.lit(9999)) + 1)

    return F.when(valid, bind(new, shown))


def phone(x: Column, key: str, back: bool) -> Column:
    raw = digits_of(x)
    own = F.substring(raw, -10, 10)
    return put_back(x, F.concat(F.substring(raw, F.lit(1), F.length(raw) - 10), permute_digits(own, key, "phone", back)))


def abroad(x: Column, key: str, back: bool) -> Column:
    """The country code stays."""
    raw = digits_of(x)
    code = F.regexp_extract(raw, f"^{COUNTRY}", 0)
    own = F.substring(raw, F.length(code) + 1, F.length(raw))
    return put_back(x, F.concat(code, permute_digits(own, key, "phone", back)))


def remainder(characters: Column) -> Column:
    """The remainder of 97 of a string of digits and capitals, which stand for 10 to 35."""

    def add(total: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), total * 10 + c.cast("int")).otherwise(total * 100 + F.ascii(c) - 55)
        return (value % 97).cast("int")

    return F.aggregate(F.split(characters, ""), F.lit(0), add)


def account(x: Column, key: str, back: bool) -> Column:
    """Country and letters stay; digits are permuted and the check digits made right."""
    raw = F.translate(x, " ", "")
    moved = lambda body, check: F.concat(body, F.substring(raw, 1, 2), check)
    own = F.substring(raw, F.lit(5), F.length(raw))
    valid = (remainder(moved(own, F.substring(raw, 3, 2))) == 1) & (F.length(raw) <= 34) & own.rlike("[0-9]")
    body = put_back(own, permute_long(F.regexp_replace(own, "[^0-9]", ""), key, "account", back))

    def whole(new: Column) -> Column:
        check = F.lpad((98 - remainder(moved(new, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(raw, 1, 2), check, new)

    return F.when(valid, put_back(x, bind(bind(body, whole), lambda v: F.regexp_replace(v, "[^0-9]", ""))))


def card(x: Column, key: str, back: bool) -> Column:
    raw = digits_of(x)
    body = permute_digits(F.substring(raw, F.lit(1), F.length(raw) - 1), key, "card", back)

    def checked(d: Column) -> Column:
        return F.concat(d, F.pmod(10 - luhn_sum(F.concat(d, F.lit("0"))) % 10, F.lit(10)).cast("string"))

    return F.when(luhn_sum(raw) % 10 == 0, put_back(x, bind(body, checked)))


CHANGE: dict[str, tuple[str, Callable[[Column, str, bool], Column]]] = {
    "mail": (MAIL, mail), "secret": (HEX, secret), "address": (ADDRESS, address), "date": (DATE, date), "social": (SOCIAL, social), "phone": (PHONE, phone), "abroad": (ABROAD, abroad), "card": (CARD, card),
    "account": (ACCOUNT, account),
}


def pseudonym(found: Column, key: str, back: bool = False) -> Column:
    """Struct `(kind, value)` for one candidate; null kind if it does not validate."""
    kind = value = None
    for name, (pattern, change) in CHANGE.items():
        fits = found.rlike(f"^(?:{pattern})$")
        new = change(found, key, back)
        label = F.lit("phone" if name == "abroad" else name)
        kind = F.when(fits, label) if kind is None else kind.when(fits, label)
        value = F.when(fits, new) if value is None else value.when(fits, new)
    return bind(value, lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), F.coalesce(v, found).alias("value")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii", back: bool = False) -> DataFrame:
    """`docs` with personal data replaced in `text_col`, and `found_col`: the kinds replaced, in order.

    A column `found_col` of the input is replaced.  `back` undoes it (mail addresses cannot be undone).
    """
    text = F.col(text_col)

    def join(changed: Column) -> Column:
        values = F.transform(changed, lambda c: c["value"])
        whole = F.zip_with(F.split(text, PATTERN), values, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.struct(F.array_join(whole, "").alias("text"), F.filter(F.transform(changed, lambda c: c["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    candidates = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    changed = F.transform(candidates, lambda x: pseudonym(x, key, back))
    plain = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    done = F.when(text.rlike("[0-9@]"), bind(changed, join)).otherwise(plain)
    both = docs.drop(found_col).select(whole_row(docs.drop(found_col)), done.alias("done"))
    return both.select(F.col("doc").withField(text_col, F.col("done.text")).alias("doc"), "done").select("doc.*", F.col("done.kinds").alias(found_col))
