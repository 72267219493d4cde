"""Personal data: keyed, format-preserving pseudonyms, as column expressions only.

One pattern finds candidates; each is validated (Luhn for cards, mod 97 for IBANs,
octets, calendar dates, number ranges) and, if it is what it looks like, replaced by
a keyed permutation of its own format: a Feistel network over the halves of its
characters, or over a mixed radix for addresses, dates and social security numbers.
The same value gives the same pseudonym in every document, in every run with the
same key, without any join; pseudonyms of validated kinds are valid again.

A value is brought to one form first, so its spellings stay linked: addresses fold their case
(which is put back on the pseudonym), numbers drop their spacing, a country code
is told by the table of codes and not by the spacing, dates are days. Different days have
different texts: with slashes the month is written first, whatever the order was.

Kinds: email (local part), ipv4, card, phone (with a country code, or ten digits with the
first three in brackets), iban, ssn, date (1900 to 2099; ISO, slashes, dots) and
secret (hexadecimal values assigned to a token, key, secret or password). Numbers that
fail validation are left alone.

Defined results: null texts stay null with no finds, empty texts stay empty; equal
rows give equal rows; extra columns pass through (``pseudonymise`` touches text only).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.llm.tables import free_name, table

KEY = "pseudonym-key-1"  # set your own
ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"  # letters beyond a-z that move among themselves
# Country calling codes of one and of two digits; all others have three.
CODES = ("1", "7", "20", "27", *map(str, (30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58)), *map(str, (60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98)))
KINDS = ("email", "ipv4", "card", "phone", "iban", "ssn", "date", "secret")

# Every repetition is bounded and tried at the start of a run only, so long texts cost linear time.
PATTERN = "|".join(
    (
        r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}+(?:\.[A-Za-z0-9\-]{1,63}+){1,8}",
        r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
        r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
        r"(?<![\d+])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)",
        r"(?<![\d+])\+(?!1[ .\-(])\d{1,3}[ .\-]\d{2,4}[ .\-]\d{3,8}(?:[ .\-]\d{2,4})?(?!\d)",
        r"(?<![\d+])\+\d{8,15}(?!\d)",
        r"(?<![\d+)(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)",
        r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])",
        r"(?<![\d/.])\d{1,2}(?:/\d{1,2}/|\.\d{1,2}\.)\d{4}(?![\d/]|\.\d)",
        r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
        r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}([ \-])\d{6}\2\d{5})(?!\d)",
        r"(?<=(?i:token|secret|password|key)[ ]{0,3}[=:][ ]{0,3}[\"']?)(?=[0-9]{0,127}[A-Fa-f])[0-9A-Fa-f]{16,128}(?![\p{L}\p{N}])",
    )
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyed(*parts: Column | str) -> Column:
    """Hex digest of the key and the parts."""
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"), 256)


def _shifted(half: Column, digest: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moved on inside its alphabet by a byte of the digest; others stay."""

    def moved(i: Column) -> Column:
        c = half.substr(i, F.lit(1))
        step = F.conv(digest.substr((i - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for a in alphabets:
            at = F.instr(F.lit(a), c)
            out = F.when(at > 0, F.lit(a).substr((at - 1 + step) % len(a) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), moved), "")


def permuted(text: Column, alphabets: tuple[str, ...], kind: str, key: str) -> Column:
    """Feistel over the two halves of a string, at least one character long."""

    def run(t: Column) -> Column:
        cut = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(t.substr(F.lit(1), cut).alias("a"), t.substr(cut + 1, F.length(t)).alias("b"))

        def turn(s: Column, r: Column) -> Column:
            # an empty half has no characters to move
            a = F.when((r % 2 == 0) & (F.length(s["a"]) > 0), _shifted(s["a"], keyed(key, kind, r, s["b"]), alphabets)).otherwise(s["a"])
            b = F.when(r % 2 == 1, _shifted(s["b"], keyed(key, kind, r, s["a"]), alphabets)).otherwise(s["b"])
            return F.struct(a.alias("a"), b.alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))

    return let(text, run)


def permuted_pair(a: Column, b: Column, size_a: int, size_b: int, kind: str, key: str) -> Column:
    """Feistel over a in [0, size_a) and b in [0, size_b): a struct (a, b)."""

    def number(digest: Column) -> Column:
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")

    def turn(s: Column, r: Column) -> Column:
        x = F.when(r % 2 == 0, (s["a"] + number(keyed(key, kind, r, s["b"]))) % size_a).otherwise(s["a"])
        y = F.when(r % 2 == 1, (s["b"] + number(keyed(key, kind, r, s["a"]))) % size_b).otherwise(s["b"])
        return F.struct(x.alias("a"), y.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def luhn(digits: Column, first_double: int) -> Column:
    """Luhn sum from the right; ``first_double`` is 1 where the last digit is doubled."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int") * F.when((i + first_double) % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def mod97(text: Column) -> Column:
    """Remainder of an IBAN's number: letters count as 10 to 35."""

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(text.substr(i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def dressed(template: Column, fresh: Column, fits: str) -> Column:
    """``fresh`` poured into the characters of ``template`` that match ``fits``."""

    def add(s: Column, i: Column) -> Column:
        c = template.substr(i, F.lit(1))
        mine = c.rlike(fits)
        return F.struct(F.concat(s["out"], F.when(mine, fresh.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(mine, 1).otherwise(0)).cast("int").alias("at"))

    return F.aggregate(F.sequence(F.lit(1), F.length(template)), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), add, lambda s: s["out"])


def _email(m: Column, key: str) -> Column:
    """The local part, folded; its case goes back on the pseudonym."""

    def fresh(local: Column) -> Column:
        one = lambda c, o: F.when(o == F.lower(o), c).otherwise(F.upper(c))
        letters = lambda t: F.split(t, "")
        return let(permuted(F.lower(local), (LOWER, DIGITS, LATIN), "email", key), lambda new: F.when(local == F.lower(local), new).otherwise(F.array_join(F.zip_with(letters(new), letters(local), one), "")))

    return F.concat(let(F.substring_index(m, "@", 1), fresh), F.lit("@"), F.substring_index(m, "@", -1))


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return let(
        o,
        lambda o: F.when(
            F.forall(o, lambda x: x <= 255),
            let(permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4", key), lambda p: F.concat_ws(".", *[F.floor(x).cast("long").cast("string") for x in (p["a"] / 256, p["a"] % 256, p["b"] / 256, p["b"] % 256)])),
        ),
    )


def _card(m: Column, key: str) -> Column:
    def fresh(d: Column) -> Column:
        return let(permuted(d, (DIGITS,), "card", key), lambda p: F.concat(p, ((10 - luhn(p, 1) % 10) % 10).cast("string")))

    digits = F.regexp_replace(m, r"[^0-9]", "")
    return let(digits, lambda d: F.when(luhn(d, 0) % 10 == 0, dressed(m, fresh(d.substr(F.lit(1), F.length(d) - 1)), "[0-9]")))


def _phone(m: Column, key: str) -> Column:
    """The digits behind the country code; ten digits without one are a number of the code 1."""
    digits = F.regexp_replace(m, r"[^0-9]", "")

    def fresh(d: Column) -> Column:
        code = F.when(m.startswith("("), 0).when(d.substr(F.lit(1), F.lit(1)).isin(*[c for c in CODES if len(c) == 1]), 1).when(d.substr(F.lit(1), F.lit(2)).isin(*[c for c in CODES if len(c) == 2]), 2).otherwise(3)
        return let(code, lambda n: dressed(m, F.concat(d.substr(F.lit(1), n), permuted(d.substr(n + 1, F.length(d)), (DIGITS,), "phone", key)), "[0-9]"))

    return let(digits, fresh)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))

    def fresh(s: Column) -> Column:
        body, land = s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(2))
        return let(permuted(body, (DIGITS, UPPER), "iban", key), lambda b: F.concat(land, F.lpad((98 - mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))

    return let(plain, lambda s: F.when(mod97(F.concat(s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(4)))) == 1, dressed(m, fresh(s), "[A-Z0-9]")))


def _ssn(m: Column, key: str) -> Column:
    p = F.transform(F.split(m, "-"), lambda x: x.cast("int"))

    def fresh(p: Column) -> Column:
        index = p[0] - F.when(p[0] > 666, 2).otherwise(1)

        def shown(s: Column) -> Column:
            area = F.floor(s["a"] / 99) + 1
            area = area + F.when(area >= 666, 1).otherwise(0)
            return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0"))

        ok = (p[0] > 0) & (p[0] < 900) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
        return F.when(ok, let(permuted_pair(index * 99 + p[1] - 1, p[2] - 1, 898 * 99, 9999, "ssn", key), shown))

    return let(p, fresh)


def _date(m: Column, key: str) -> Column:
    """The 73,049 days from 1900 to 2099 are 319 x 229."""
    p = F.transform(F.split(m, r"[\-/.]"), lambda x: x.cast("int"))
    iso, slash = m.rlike("^[0-9]{4}-"), m.contains("/")

    def fresh(s: Column) -> Column:
        p = s["p"]
        # slashes: month first where that is a month, else day first; dots: day first
        swap = s["slash"] & (p[0] <= 12)
        y = F.when(s["iso"], p[0]).otherwise(p[2])
        mo = F.when(s["iso"] | ~swap, p[1]).otherwise(p[0])
        d = F.when(s["iso"], p[2]).when(swap, p[1]).otherwise(p[0])
        day = F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd")
        n = F.datediff(day, F.lit("1900-01-01").cast("date"))

        def shown(t: Column) -> Column:
            new = F.date_add(F.lit("1900-01-01").cast("date"), (t["a"] * 229 + t["b"]).cast("int"))
            short = m.rlike(r"^\d[/.]|[/.]\d[/.]")
            # one order for all, or two days would have one text
            slashes = F.when(short, F.date_format(new, "M/d/yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy"))
            dots = F.when(short, F.date_format(new, "d.M.yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
            return F.when(s["iso"], F.date_format(new, "yyyy-MM-dd")).when(s["slash"], slashes).otherwise(dots)

        return let(n, lambda n: F.when((n >= 0) & (n < 319 * 229), let(permuted_pair(F.floor(n / 229), n % 229, 319, 229, "date", key), shown)))

    return let(F.struct(p.alias("p"), iso.alias("iso"), slash.alias("slash")), fresh)


def _secret(m: Column, key: str) -> Column:
    lower = F.lower(m)
    fresh = permuted(lower, ("0123456789abcdef",), "secret", key)
    return F.when(m == lower, fresh).when(m == F.upper(m), F.upper(fresh)).otherwise(fresh)


def pseudonym(m: Column, key: str) -> Column:
    """A struct (kind, text); null kind where the candidate is not valid."""
    dotted_date = m.rlike(r"^\d{1,2}[/.]\d{1,2}[/.]\d{4}$") | m.rlike(r"^\d{4}-\d{2}-\d{2}$")
    kind = (
        F.when(m.contains("@"), "email")
        .when(m.startswith("+") | m.startswith("("), "phone")
        .when(dotted_date, "date")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[0-9 \-]+$"), "card")
        # up to 34 characters of this shape are an IBAN or nothing, even where all are hexadecimal
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){1,30}$"), "iban")
        .when(m.rlike(r"^[0-9A-Fa-f]{16,128}$"), "secret")
    )
    makers = {"email": _email, "phone": _phone, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "card": _card, "iban": _iban, "secret": _secret}

    def made(k: Column) -> Column:
        out = None
        for name, maker in makers.items():
            out = F.when(k == name, maker(m, key)) if out is None else out.when(k == name, maker(m, key))
        return let(out, lambda t: F.struct(F.when(t.isNotNull(), k).alias("kind"), F.coalesce(t, m).alias("text")))

    return let(kind, made)


def with_finds(docs: DataFrame, key: str = KEY) -> tuple[DataFrame, str]:
    """``docs`` with text replaced, and a column of kinds found (its name is returned)."""
    finds, parts = free_name(docs, "pii_kinds"), free_name(docs, "pii_parts")
    text = F.col("text")
    # most texts without a digit can hold nothing but an address of letters
    maybe = text.rlike("[0-9@]")
    candidates = F.regexp_extract_all(text, F.lit(PATTERN), 0)
    read = docs.withColumn(parts, F.when(maybe, F.transform(candidates, lambda m: pseudonym(m, key))))
    kinds = F.filter(F.coalesce(F.col(f"{parts}.kind"), F.array().cast("array<string>")), lambda k: k.isNotNull())
    gaps = F.split(text, PATTERN, -1)
    fresh = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(f"{parts}.text"), i), F.lit("")))), "")
    done = read.withColumn(finds, kinds)
    replaced = F.when(F.size(finds) > 0, fresh).otherwise(text)
    return done.select(*[replaced.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col(finds)), finds


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    done, finds = with_finds(docs, key)
    return done.drop(finds)


def op4_pseudonyms(spark, sf_dir):
    done, finds = with_finds(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [(F.size(finds) - F.size(F.array_remove(finds, name))).cast("long").alias(f"n_{name}") for name in KINDS]
    return done.select("doc_id", "text", F.size(finds).cast("long").alias("n_found"), *counts)
