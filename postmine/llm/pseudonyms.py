"""Format-preserving pseudonyms for personal numbers, dates, addresses and keys, in built-in functions only.

Each value found is validated, permuted within its own format by a keyed Feistel network, and put back in place.
The permutation depends on the key and the kind alone, so equal values get equal pseudonyms in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS = "0123456789"
HEX = "0123456789abcdef"
LETTERS_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
CAPITALS_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Dates of two hundred years, as a rectangle of 17 by 4297 days.
FIRST_DAY, DAY_ROWS, DAY_COLUMNS = "1900-01-01", 17, 4297
#: The days of all other four-digit years, 0000 to 9999: those before FIRST_DAY, and a rectangle of them all.
DAYS_BEFORE, OTHER_ROWS, OTHER_COLUMNS = 693961, 16, 223711
#: Symbols that one hash has steps for.
BLOCK = 64

#: By kind, in order of preference where two begin at the same place. All are linear: no part can match in two ways.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?:"
    r"(?:password|passwd|token|secret|api_key|apikey|PASSWORD|PASSWD|TOKEN|SECRET|API_KEY|APIKEY) ?[=:] ?[\"']?[0-9A-Fa-f]{16,}+))(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
    r"(?![A-Za-z0-9]|[./-][0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![A-Za-z0-9]|[-.][0-9])",
    "card": r"(?<![A-Za-z0-9.])(?:[0-9]{13,19}+|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
}
FOUND = "|".join(SHAPES.values())
#: Every shape holds a digit or an at sign.
HINT = "[0-9@]"


def _below(seed: Column, bound: int) -> Column:
    """A number below ``bound`` (at most 2 ** 32) made from a text."""
    return F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long"), F.lit(bound))


def feistel_text(value: Column, alphabet: str, key: Column) -> Column:
    """A keyed permutation of the texts of one length over ``alphabet``.

    The halves take turns; every symbol of one is moved along the alphabet by a hash of the other. A single
    symbol is moved by a hash of the key.
    """
    half = (F.length(value) / 2).cast("int")

    def moved(text: Column, by: Column) -> Column:
        def shifted(part: Column, steps: Column) -> Column:
            def move(c: Column, i: Column) -> Column:
                step = F.conv(F.substr(steps, F.lit(1) + i * 2, F.lit(2)), 16, 10).cast("int")
                return F.substr(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + step, F.lit(len(alphabet))) + 1, F.lit(1))

            return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), move), "")

        def blocks(first: Column) -> Column:
            def block(k: Column) -> Column:
                steps = F.array(F.when(k == 0, first).otherwise(F.sha2(F.concat_ws("/", first, k), 512)))
                return F.aggregate(steps, F.lit(""), lambda _, s: shifted(F.substr(text, k * BLOCK + 1, F.lit(BLOCK)), s))

            last = F.greatest(F.floor((F.length(text) - 1) / BLOCK).cast("int"), F.lit(0))
            return F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")

        # An array of one gives a hash a name, so that it is made once and not for every symbol.
        return F.aggregate(F.array(F.sha2(by, 512)), F.lit(""), lambda _, first: blocks(first))

    def turn(pair: Column, i: Column) -> Column:
        return F.struct(pair["b"].alias("a"), moved(pair["a"], F.concat_ws("/", key, F.length(value), i, pair["b"])).alias("b"))

    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1, F.length(value)).alias("b"))
    many = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda p: F.concat(p["a"], p["b"]))
    return F.when(F.length(value) < 2, moved(value, key)).otherwise(many)


def feistel_number(value: Column, rows: int, columns: int, key: Column) -> Column:
    """A keyed permutation of the numbers below ``rows * columns``."""

    def turn(at: Column, i: Column) -> Column:
        a = F.pmod(at["a"] + _below(F.concat_ws("/", key, i, F.lit("a"), at["b"]), rows), F.lit(rows))
        b = F.pmod(at["b"] + _below(F.concat_ws("/", key, i, F.lit("b"), a), columns), F.lit(columns))
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(F.floor(value / columns).cast("long").alias("a"), F.pmod(value.cast("long"), F.lit(columns)).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda at: at["a"] * columns + at["b"])


def _refill(template: Column, taken: str, text: Column) -> Column:
    """``template`` with its characters of class ``taken`` replaced by those of ``text``, in order."""

    def put(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(template, F.lit(1), i), f"[^{taken}]", ""))
        return F.when(c.rlike(f"[{taken}]"), F.substr(text, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(template, ""), put), "")


def _luhn(digits: Column, doubled: int) -> Column:
    """The sum of digits of the Luhn rule, where the last digit has weight 1 + ``doubled``."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(F.pmod(i + doubled, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """The remainder of an account number whose letters count from A = 10."""

    def add(rest: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.pmod(F.when(v > 9, rest * 100 + v).otherwise(rest * 10 + v), F.lit(97))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _case(like: Column, text: Column) -> Column:
    """``text``, made of small letters, in capitals where ``like`` has no small ones."""
    return F.when(like == F.upper(like), F.upper(text)).otherwise(text)


def _email(value: Column, key: Column) -> Column:
    local, rest = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    plain = F.lower(local)
    symbols = F.regexp_replace(plain, "[^a-z0-9]", "")
    moved = _refill(plain, "a-z0-9", feistel_text(symbols, LETTERS_DIGITS, F.concat(key, F.lit("email"))))
    return F.when(symbols != "", F.concat(_case(local, moved), F.lit("@"), rest))


def _key(value: Column, key: Column) -> Column:
    own = F.concat(key, F.lit("key"))
    access = F.concat(F.lit("AKIA"), feistel_text(F.substr(value, F.lit(5), F.lit(16)), CAPITALS_DIGITS, own))
    name = F.regexp_extract(value, "^[A-Za-z_]+ ?[=:] ?[\"']?", 0)
    secret = F.substr(value, F.length(name) + 1, F.length(value))
    return F.when(value.rlike("^AKIA"), access).otherwise(F.concat(name, _case(secret, feistel_text(F.lower(secret), HEX, own))))


def _iban(value: Column, key: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(account, F.substr(plain, F.lit(1), F.lit(4)))) == 1)
    # Letters stay where they are; the digits of the account are permuted and the check digits made anew.
    moved = _refill(account, "0-9", feistel_text(_digits(account), DIGITS, F.concat(key, F.lit("iban"))))
    check = F.lpad((F.lit(98) - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, _refill(value, "A-Z0-9", F.concat(country, check, moved)))


def _ip(value: Column, key: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    moved = feistel_number(number, 65536, 65536, F.concat(key, F.lit("ip")))

    def shown(n: Column) -> Column:
        return F.concat_ws(".", *(F.pmod(F.floor(n / 256**i).cast("long"), F.lit(256)).cast("string") for i in (3, 2, 1, 0)))

    return F.when(F.array_max(parts) < 256, F.aggregate(F.array(moved), F.lit(""), lambda _, n: shown(n)))


def _date(value: Column, key: Column) -> Column:
    iso = value.rlike("^[0-9]{4}-")
    parts = F.split(value, "[-./]")
    # A slash puts the month first unless only the day can stand there; dots and dashes leave no choice.
    a, b = parts[0].cast("int"), parts[1].cast("int")
    month_first = value.contains("/") & (a <= 12)
    order = F.when(iso, F.concat_ws("-", parts[0], parts[1], parts[2])).when(
        month_first, F.concat_ws("-", parts[2], F.lpad(a.cast("string"), 2, "0"), F.lpad(b.cast("string"), 2, "0"))
    ).otherwise(F.concat_ws("-", parts[2], F.lpad(b.cast("string"), 2, "0"), F.lpad(a.cast("string"), 2, "0")))
    day = F.datediff(order.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    inner, inside = DAY_ROWS * DAY_COLUMNS, day.between(0, DAY_ROWS * DAY_COLUMNS - 1)
    # Days of other years keep their order, without a gap for the two hundred years in between.
    other = F.when(day < 0, day + DAYS_BEFORE).otherwise(day + DAYS_BEFORE - inner)
    other = feistel_number(other, OTHER_ROWS, OTHER_COLUMNS, F.concat(key, F.lit("other date"))) - DAYS_BEFORE
    other = F.aggregate(F.array(other), F.lit(0).cast("long"), lambda _, n: F.when(n < 0, n).otherwise(n + inner))
    moved = F.when(inside, feistel_number(day, DAY_ROWS, DAY_COLUMNS, F.concat(key, F.lit("date")))).otherwise(other)

    def shown(n: Column) -> Column:
        to = F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
        sign = F.substr(F.regexp_replace(value, "[0-9]", ""), F.lit(1), F.lit(1))
        month, dom, year = (F.substr(to.cast("string"), F.lit(at), F.lit(n)) for at, n in ((6, 2), (9, 2), (1, 4)))
        return F.when(iso, F.concat_ws("-", year, month, dom)).when(month_first, F.concat(month, sign, dom, sign, year)).otherwise(
            F.concat(dom, sign, month, sign, year)
        )

    return F.when(day.isNotNull(), F.aggregate(F.array(moved), F.lit(""), lambda _, n: shown(n)))


def _ssn(value: Column, key: Column) -> Column:
    """Valid numbers are numbered without gaps, so a permutation of these numbers stays among them."""
    valid = ~value.rlike("^(000|666|9)|-00-|-0000$")
    area, group, serial = (F.substr(_digits(value), F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    moved = feistel_number(number, 898 * 99, 9999, F.concat(key, F.lit("ssn")))

    def shown(n: Column) -> Column:
        place = F.floor(n / (99 * 9999)).cast("long")
        return F.concat(
            F.lpad((place + F.when(place > 664, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.pmod(F.floor(n / 9999).cast("long"), F.lit(99)) + 1).cast("string"), 2, "0"),
            F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"),
        )

    return F.when(valid, _refill(value, "0-9", F.aggregate(F.array(moved), F.lit(""), lambda _, n: shown(n))))


def _phone(value: Column, key: Column) -> Column:
    # The country code stays.
    head = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]|^", 0)
    rest = F.substr(value, F.length(head) + 1, F.length(value))
    moved = _refill(rest, "0-9", feistel_text(_digits(rest), DIGITS, F.concat(key, F.lit("phone"))))
    return F.when(F.length(_digits(value)).between(7, 15), F.concat(head, moved))


def _card(value: Column, key: Column) -> Column:
    digits = _digits(value)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    moved = feistel_text(body, DIGITS, F.concat(key, F.lit("card")))

    def whole(text: Column) -> Column:
        return F.concat(text, F.pmod(-_luhn(text, 1), F.lit(10)).cast("string"))

    new = F.aggregate(F.array(moved), F.lit(""), lambda _, text: whole(text))
    return F.when(F.pmod(_luhn(digits, 0), F.lit(10)) == 0, _refill(value, "0-9", new))


MAKERS = {"email": _email, "key": _key, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value found, or null where it is none of the valid kinds."""
    made = F.lit(None).cast("string")
    for kind, shape in reversed(SHAPES.items()):
        made = F.when(value.rlike(f"^(?:{shape})$"), MAKERS[kind](value, F.lit(key + "/"))).otherwise(made)
    return made


def pseudonymize(docs: DataFrame, key: str, column: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the personal values in ``column`` replaced; all rows and other columns stay as they are.

    ``count`` names a further column, not one of ``docs``, for the number of values replaced. Numbers that fail their
    check (Luhn, mod 97, octets, calendar, ranges of other numbers) stay. A null text stays null with a count of 0; texts
    without a value stay the same. Where two kinds overlap, the one that begins first is taken, then the one that SHAPES
    names first. An address in capitals and in small letters is one value; its domain stays, as does a local part without
    a letter or digit.
    """
    if count and count.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {count}")
    text = F.col(f"`{column}`")
    hits = F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))
    new = F.transform(hits, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))
    has = F.coalesce(text.rlike(HINT) & text.rlike(FOUND), F.lit(False))
    gaps = F.split(text, FOUND, -1)
    # Made in steps, each in a column of its own, so that no text is searched twice for the same thing.
    made, changes = (_unused(name, docs.columns) for name in ("__new", "__changed"))
    marked = docs.withColumn(made, F.when(has, new))
    put = F.concat(
        gaps[0],
        F.array_join(
            F.zip_with(F.col(made), F.slice(gaps, F.lit(2), F.size(made)), lambda n, gap: F.concat(F.coalesce(n["new"], n["old"]), gap)), ""
        ),
    )
    changed = F.size(F.filter(made, lambda n: n["new"].isNotNull()))
    out = marked.withColumn(changes, F.when(F.col(made).isNull(), 0).otherwise(changed).cast("long"))
    out = out.withColumn(column, F.when(F.col(changes) > 0, put).otherwise(text))
    return (out.withColumn(count, F.col(changes)) if count else out).drop(made, changes)


def _unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it, in any case of letters."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name
