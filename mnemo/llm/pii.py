"""Personal data replaced by surrogates.

Entities are found by one expression and replaced in the same projection; the
text is never shuffled.  What all spellings of an entity have in common is its
value; a secret key, the kind and the value give the surrogate value, which is
then spelled as the entity was.  So an entity has one surrogate wherever it
occurs, in any format and under any title.  It keeps kind, format, script and,
for names, gender.  A check over all distinct values finds surrogates that two
of them would share, or that equal another entity; those get further attempts
until none is left.  Numbers of a kind and length that fill a quarter of their
space or more are exchanged by a keyed permutation of that space instead.
"""

from __future__ import annotations

import hmac
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.llm.common import let
from mnemo.sources.durable import durable, job_dir

#: Titles by gender, and given names by script and gender, "u" for those of either (fixed values).
TITLES = {"m": "Mr|Herr|Señor|Sr|Monsieur|господин|г-н", "f": "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|госпожа|г-жа", "u": "Dr|Prof"}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Peter Paul Hans Karl Pierre Jean Carlos Juan Ahmed Ali Omar Mohammed Hassan Raj Arjun Wei Hiroshi Luis Miguel José Antoine Stefan Klaus Jürgen Andreas".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Anna Laura Julia Ingrid Petra Marie Claire Carmen Lucia Fatima Aisha Leila Priya Mei Yuki Sofia Isabel Ana Sophie Monika Sabine Ursula Emma Olivia Margaret Zoë".split(),
    ("latin", "u"): "Alex Sam Robin Kim Jamie Jordan Taylor Morgan Casey Riley Quinn Avery Charlie Rowan Sasha Noor".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Николай Павел Михаил Андрей".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "u"): "Саша Женя Валя Слава Шура Паша".split(),
}
SYLLABLES = {"latin": "ba be bo da del do fa fen ga gor ha hel ka kel la lin lo ma mer mo na nor pa pel ra rin ro sa sel so ta tor va vel vo wen".split(), "cyrillic": "ба бе бо ва вел го да дер за ка кол ла лен ма мир на нов па пет ра рин ро са сев та тор фа хо ша".split()}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}
#: Endings of Russian family names that tell gender.
ENDING = "(?:ова|ева|ёва|ина|ына|ская|цкая|ов|ев|ёв|ин|ын|ский|цкий)$"
#: Words after which a name stands.
CUES = "[Mm]y name is|[Nn]ame:|[Cc]ontact:|[Ss]igned,|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo|зовут"
#: Country codes of telephone numbers; all others have three digits (fixed values).
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Words between a given and a family name, and words before a secret (fixed values).
PARTICLES = "van|von|de|der|den|del|della|di|da|dos|du|la|le|bin|ibn|al|el|ter|ten|zu"
SECRETS = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"

_NAME = r"\p{Lu}\p{L}*\p{Ll}(?:-\p{Lu}\p{Ll}+)?"
_TITLE = "|".join(TITLES.values())
_GIVEN = "|".join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True))
_CAPS = _GIVEN.upper()
_CUE = r"[:=]\s{0,2}[\"']?"
_GAP = r"[ .()-]{0,3}\d"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_MAIL = r"\p{L}\p{M}\p{N}._+-"
ENTITY = "|".join(
    [
        # a secret is what follows its cue and holds a digit; it is looked for from the sign after the cue on
        rf"(?=[:=])(?<=(?i:{SECRETS})[\"']?\s{{0,2}}){_CUE}(?=[^\s\"',;&<>]*\d)[^\s\"',;&<>]{{5,}}[^\s\"',;&<>.]",
        r"(?<=PRIVATE KEY-----)[A-Za-z0-9+/=\s]{60,}(?=-----END)",
        rf"(?<![{_MAIL}])[{_MAIL}]*[\p{{L}}\p{{M}}\p{{N}}_+-]@[\p{{L}}\p{{M}}\p{{N}}-]+(?:\.[\p{{L}}\p{{M}}\p{{N}}-]+)*\.\p{{L}}{{2,}}",
        rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
        # eight groups, or fewer around one gap and then with a digit
        r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,30}\d)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![\p{L}\p{N}:])",
        r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9-]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})",
        r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        # after 00 as after a +, with separators or of a telephone number's whole length
        rf"(?<![\d.,/-])(?<!\d )00(?: ?(?=[1-9]\d{{0,2}}[ .(-])[1-9]\d{{0,2}}(?:[ .-]?\(?\d{{1,4}}\)?){{2,5}}(?!\d)(?<=\d{_GAP * 7}\)?)|[1-9]\d{{9,13}}(?![\d.]))",
        # lengths and first digits of card numbers; the check digit is asked later
        r"(?<![0-9A-Za-z.])(?:4\d{12}|3[068]\d{12}|3[47]\d{13}|[2-6]\d{15,18}|[2-6]\d{3}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|3[47]\d{2}[ -]\d{6}[ -]\d{5})(?![0-9A-Za-z]|\.\d)",
        # seven digits at least: ahead for speed, behind for what is matched in the end
        r"\+(?=\d(?:[ .()-]{0,3}\d){6})\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)" + rf"(?<=\d{_GAP * 6}\)?)",
        r"(?<![\d.(-])\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?![\d-])",
        # national numbers with their trunk digit: in pairs, or an area code and the rest
        r"(?<![\d.,/-])(?<!\d )0[1-9](?:[ .]\d{2}){4}(?![ .,]?\d)",
        r"(?<![\d.,/-])(?<!\d )\(?0[1-9]\d{1,4}\)?[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,2}(?![ .,]?\d)",
        rf"(?=[\p{{Lu}}г])(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?",
        r"(?<![\d.,/-])(?<!\d )0[1-9]-\d{7,8}(?![ .,]?\d)",
        rf"(?=\p{{Lu}}\p{{Ll}})(?<!\p{{L}})(?:{_GIVEN})(?: (?:{PARTICLES})){{0,3}} {_NAME}",
        rf"(?=\p{{Lu}}{{2}})(?<!\p{{L}})(?:{_CAPS}) \p{{Lu}}{{2,}}(?:-\p{{Lu}}{{2,}})?(?!\p{{L}})",
        rf"(?=\p{{Lu}})(?<=(?:{CUES}) ){_NAME}(?: {_NAME})?",
    ]
)
CAPITALS = r"^\p{Lu}{2,} \p{Lu}{2,}(?:-\p{Lu}{2,})?$"
#: Every entity holds one of these; texts without them are passed on as they are.
HINT = rf"[0-9@]|::|AKIA|gh[pousr]_|sk-|xox|eyJ|PRIVATE KEY-|(?=[\p{{Lu}}г])(?<!\p{{L}})(?:{_TITLE}|{_GIVEN}|{_CAPS})\.? \p{{L}}|(?:{CUES}) \p{{Lu}}"
#: Up to so many entities with a later attempt become a constant of the plan; more are joined.
SMALL_ROWS = 500


def kind_of(e: Column) -> Column:
    """The kind; ``number`` is one that only looks like a card's, and stays."""
    return let(uncued(e), lambda own: _kind(e, own))


def _kind(e: Column, own: Column) -> Column:
    return (
        F.when((own != e) & own.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$"), "hex")
        .when(own.rlike(r"^(?:AKIA|gh[pousr]_|sk-|xox|eyJ)"), "key")
        .when(own != e, "secret")
        .when(e.contains("@"), "email")
        .when(e.rlike(r"^[A-Za-z0-9+/=\s]{60,}$"), "pem")
        .when(e.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^[0-9A-Fa-f]{1,4}:"), "ip6")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(like_card(e), F.when(luhn(digits(e)), "card").otherwise("number"))
        .when(e.rlike(r"^[+(\d]"), "phone")
        .otherwise("name")
    )


def like_card(e: Column) -> Column:
    return e.rlike(r"^[2-6](?:[ -]?\d){12,18}$")


def uncued(e: Column) -> Column:
    """A secret without the cue before it."""
    return F.regexp_replace(e, f"^{_CUE}", "")


def luhn_sum(body: Column) -> Column:
    """Luhn's sum of the digits before a check digit."""
    twice = lambda c: F.when(c > 4, c * 2 - 9).otherwise(c * 2)
    return F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, twice(c.try_cast("int"))).otherwise(c.try_cast("int"))), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))


def luhn(value: Column) -> Column:
    return (luhn_sum(F.left(value, F.length(value) - 1)) + F.right(value, F.lit(1)).try_cast("int")) % 10 == 0


def digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def untitled(e: Column) -> Column:
    return F.regexp_replace(e, rf"^(?:{_TITLE})\.? ", "")


def dialled(e: Column) -> Column:
    """The digits before a telephone number's own: country code and trunk digit."""
    d = digits(e)
    return F.when(e.startswith("+"), F.regexp_extract(d, f"^{COUNTRY}0?", 0)).when(d.startswith("00"), F.regexp_extract(d, f"^00{COUNTRY}0?", 0)).otherwise(F.regexp_extract(d, "^0?", 0))


def groups(e: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address."""
    part = lambda i: F.filter(F.split(F.get(F.split(F.lower(e), "::"), i), ":"), lambda g: g != "")
    four = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda g: F.lpad(g, 4, "0"))
    left, right = four(part(0)), four(part(1))
    return F.array_join(F.concat(left, F.array_repeat(F.lit("0000"), 8 - F.size(left) - F.size(right)), right), "")


def value_of(e: Column, kind: Column) -> Column:
    """What all spellings of one entity have in common."""
    return (
        F.when(kind.isin("card", "ssn"), digits(e))
        .when(kind == "phone", F.substr(digits(e), F.length(dialled(e)) + 1))
        .when(kind == "email", F.lower(e))
        .when(kind == "hex", F.lower(uncued(e)))
        .when(kind.isin("key", "secret"), uncued(e))
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .when(kind == "ip6", groups(e))
        .when(kind == "name", F.when(e.rlike(CAPITALS), F.initcap(e)).otherwise(untitled(e)))
        .otherwise(e)
    )


def pseudo(key: Column | str, kind: Column | str, value: Column, attempt: Column) -> Column:
    """64 hex digits that nobody without ``key`` can compute."""
    key, kind = (F.lit(c) if isinstance(c, str) else c for c in (key, kind))
    return F.sha2(F.concat_ws("\x1f", key, kind, value, attempt.cast("string"), key), 256)


def number(hexed: Column, at: Column | int, n: int = 7) -> Column:
    return F.conv(F.substr(hexed, at if isinstance(at, Column) else F.lit(at), F.lit(n)), 16, 10).cast("long")


def as_digits(hexed: Column) -> Column:
    return F.translate(hexed, "abcdef", "012345")


def spelled(e: Column, new: Column, marks: str = "[0-9]") -> Column:
    """``e`` with its ``marks``, in order, replaced by the characters of ``new``."""
    nth = lambda i: F.regexp_count(F.substr(e, F.lit(1), i), F.lit(marks))
    return F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike(marks), F.substr(new, nth(i) + 1, F.lit(1))).otherwise(c)), "")


def shaped(value: Column, hexed: Column, keep: Column) -> Column:
    """``value`` with digits and letters replaced by others of their kind, case and script after the first ``keep`` characters."""

    def letter(c: Column, i: Column) -> Column:
        n = number(hexed, (i * 2) % 62 + 1, 2) + i
        of = lambda script: F.substr(F.lit(LETTERS[script]), (n % len(LETTERS[script]) + 1).cast("int"), F.lit(1))
        small = F.when(c.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(small)).otherwise(small)

    one = lambda c, i: F.when(i < keep, c).when(c.rlike(r"\p{N}"), F.substr(as_digits(hexed), i % 64 + 1, F.lit(1))).when(c.rlike(r"\p{L}"), letter(c, i)).when(c.rlike(r"\p{M}"), "").otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def card_number(value: Column, hexed: Column) -> Column:
    """Digits of the same number and first digit whose last is Luhn's check digit."""
    body = F.concat(F.left(value, F.lit(1)), F.substr(as_digits(hexed), F.lit(1), F.length(value) - 2))
    return let(body, lambda b: F.concat(b, ((10 - luhn_sum(b) % 10) % 10).cast("string")))


def iban(value: Column, rest: Column) -> Column:
    """The same country, ``rest`` after it, and the check digits that it asks for."""

    def left(number_: Column) -> Column:
        chars = F.split(number_, "")
        return F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: F.when(c.rlike("[0-9]"), n * 10 + c.cast("long")).otherwise(n * 100 + F.ascii(c) - 55) % 97)

    country = F.left(value, F.lit(2))
    return F.concat(country, F.lpad((98 - left(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"), rest)


def permuted(left: Column, right: Column, a: Column, b: Column, kind: Column, key: Column | str, rounds: int = 6) -> Column:
    """struct(l, r): another pair within ``a`` and ``b``, by a keyed permutation of all pairs that leaves none in its place.

    Feistel rounds over both halves, one step forward, and the rounds back.
    """

    def step(s: Column, i: Column) -> Column:
        nth, sign = F.least(i, 2 * rounds - i), F.when(i < rounds, 1).otherwise(-1)
        first = nth % 2 == 0
        noise = number(pseudo(key, kind, F.concat_ws(":", a, b, nth, F.when(first, s["r"]).otherwise(s["l"])), F.lit(-1)), 1, 12)
        turned = F.struct(F.when(first, F.pmod(s["l"] + sign * noise, a)).otherwise(s["l"]).alias("l"), F.when(first, s["r"]).otherwise(F.pmod(s["r"] + sign * noise, b)).alias("r"))
        onward = F.struct(F.when(s["r"] + 1 < b, s["l"]).otherwise(F.pmod(s["l"] + 1, a)).alias("l"), F.pmod(s["r"] + 1, b).alias("r"))
        return F.when(i == rounds, onward).otherwise(turned)

    return F.aggregate(F.array(*map(F.lit, range(2 * rounds + 1))), F.struct(left.alias("l"), right.alias("r")), step)


def permuted_digits(value: Column, kind: Column, key: Column | str) -> Column:
    n = F.length(value)
    half = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    new = permuted(F.coalesce(F.substr(value, F.lit(1), half).try_cast("long"), F.lit(0).cast("long")), F.substr(value, half + 1).try_cast("long"), ten(half), ten(n - half), kind, key)
    return let(new, lambda s: F.concat(F.when(half > 0, F.lpad(s["l"].cast("string"), half, F.lit("0"))).otherwise(""), F.lpad(s["r"].cast("string"), n - half, F.lit("0"))))


def permuted_ip(value: Column, kind: Column, key: Column | str) -> Column:
    octet = lambda i: F.get(F.split(value, r"\."), i).try_cast("long")
    all_ = F.lit(1 << 16).cast("long")
    new = permuted(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), all_, all_, kind, key)
    return let(new, lambda s: F.concat_ws(".", *[x.cast("int").cast("string") for c in "lr" for x in (F.floor(s[c] / 256), s[c] % 256)]))


def other_name(value: Column, attempt: Column, key: Column | str) -> Column:
    """Another name of the same script; given names keep their gender, and those that tell none get one that fits both.

    The given name is tried again first, then the family name, which gets
    longer, so that there is always room.
    """
    words = F.split(value, " ")
    given, family = F.when(F.size(words) > 1, words[0]), F.element_at(words, -1)
    later = F.when(given.isNull(), attempt).otherwise(F.greatest(attempt - 8, F.lit(0)))
    ending = F.regexp_extract(family, ENDING, 0)
    listed = lambda g: F.coalesce(given.isin([n for (_, x), names in GIVEN.items() if x == g for n in names]), F.lit(False))
    ends = lambda *last: F.length(ending) * F.when(F.right(ending, F.lit(1)).isin(*last), 1).otherwise(0) > 0
    gender = F.when(listed("m"), "m").when(listed("f"), "f").when(listed("u"), "u").when(ends("а", "я"), "f").when(ends("в", "н", "й"), "m").otherwise("u")
    bound = F.struct(pseudo(key, "given", given, attempt).alias("g"), pseudo(key, "family", F.regexp_replace(family, ENDING, ""), later).alias("f"), gender.alias("gender"))

    def of(script: str, x: Column) -> Column:
        pick = lambda g: F.get(F.array(*map(F.lit, GIVEN[script, g])), (number(x["g"], 1) % len(GIVEN[script, g])).cast("int"))
        table = F.array(*map(F.lit, SYLLABLES[script]))
        parts = F.transform(F.sequence(F.lit(0), 3 + F.least(F.floor(later / 8).cast("int"), F.lit(10))), lambda k: F.get(table, (number(x["f"], k * 4 + 1, 4) % len(SYLLABLES[script])).cast("int")))
        first = F.when(x["gender"] == "m", pick("m")).when(x["gender"] == "f", pick("f")).otherwise(pick("u"))
        return F.concat_ws(" ", F.when(given.isNotNull(), first), F.concat(F.initcap(F.array_join(parts, "")), ending))

    return let(bound, lambda x: F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic", x)).otherwise(of("latin", x)))


def new_value(kind: Column, value: Column, attempt: Column, key: Column | str) -> Column:
    """The surrogate value.

    Where the format leaves the length open, later attempts get longer, so
    there is always room.  An attempt of -1 asks for a permutation.
    """

    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    free = F.when(kind == "email", local).when(kind == "iban", F.substr(value, F.lit(5))).when(kind.isin("key", "secret", "pem"), value).otherwise("")

    def of(h: Column) -> Column:
        return let(shaped(free, h, F.when(kind == "key", 4).otherwise(0)), lambda other: made(h, other))

    def made(h: Column, other: Column) -> Column:
        longer = F.left(as_digits(h), F.greatest(attempt - 8, F.lit(0)))
        octets = F.concat_ws(".", (240 + number(h, 1) % 16).cast("string"), *[(number(h, k) % 256).cast("string") for k in (8, 15, 22)])
        some = F.substr(as_digits(h), F.lit(1), F.length(value))
        # a number that does not begin with 0 gets none that does
        some = F.when(value.startswith("0"), some).otherwise(F.concat((1 + number(h, 58) % 9).cast("string"), F.substr(some, F.lit(2))))
        return (
            F.when(kind == "email", F.concat(other, longer, F.lit("@d"), F.left(pseudo(key, "domain", domain, F.lit(0)), F.lit(12)), F.lit(".example")))
            .when(kind == "ip", F.when(attempt < 0, permuted_ip(value, kind, key)).otherwise(octets))
            .when(kind == "ip6", F.concat(F.lit("20010db800000000"), F.left(h, F.lit(16))))
            .when(kind == "hex", F.substr(F.repeat(h, F.lit(2)), F.lit(1), F.length(value)))
            .when(kind.isin("key", "secret"), F.concat(other, longer))
            .when(kind == "pem", other)
            .when(kind == "iban", iban(value, other))
            .when(kind == "card", card_number(value, h))
            .when(kind.isin("phone", "ssn"), F.when(attempt < 0, permuted_digits(value, kind, key)).otherwise(some))
            .otherwise(other_name(value, attempt, key))
        )

    return let(pseudo(key, kind, value, attempt), of)


def respelled(e: Column, kind: Column, new: Column) -> Column:
    """A surrogate value as ``e`` is spelled; ``new`` stands once in the plan, however often it is read."""
    return let(new, lambda bound: _respelled(e, kind, bound))


def _respelled(e: Column, kind: Column, new: Column) -> Column:
    local = lambda x: F.substring_index(x, "@", 1)
    cased = F.array_join(F.transform(F.split(local(new), ""), lambda c, i: F.when(F.substr(local(e), i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    quad = lambda k: F.substr(new, F.lit(4 * k + 1), F.lit(4))
    low = F.concat_ws(":", *map(quad, range(4, 8)))
    six = F.when(e.contains("::"), F.concat(F.lit("2001:db8::"), low)).otherwise(F.concat(F.lit("2001:db8:0:0:"), low))
    return (
        F.when(kind == "email", F.concat(cased, F.lit("@"), F.substring_index(new, "@", -1)))
        .when(kind == "ip6", F.when(e.rlike("[A-F]"), F.upper(six)).otherwise(six))
        .when(kind.isin("hex", "key", "secret"), let(uncued(e), lambda own: F.concat(F.left(e, F.length(e) - F.length(own)), F.when((kind == "hex") & own.rlike("[A-F]"), F.upper(new)).otherwise(new))))
        .when(kind == "iban", spelled(e, new, "[^ ]"))
        .when(kind == "phone", spelled(e, F.concat(dialled(e), new)))
        .when(kind.isin("card", "ssn"), spelled(e, new))
        .when(kind == "number", e)
        .when((kind == "name") & e.rlike(CAPITALS), F.upper(new))
        .when(kind == "name", F.concat(F.left(e, F.length(e) - F.length(untitled(e))), new))
        .otherwise(new)
    )


def entities(text: Column) -> Column:
    """All entities of a text in order; none for null."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)


def secret_table(spark: SparkSession, key: str) -> DataFrame:
    """``key`` as a table of one row that only the job's user can read; written past Spark, so no plan and no event log has it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{job_dir(spark)}/secret-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(key.encode()))
    out.close()
    fs.setPermission(path, hadoop.permission.FsPermission("600"))
    return spark.read.text(path.toString()).select(F.col("value").alias("key"))


def with_key(df: DataFrame, key: DataFrame | str) -> DataFrame:
    """``df`` and the one row of ``key`` as ``_secret``."""
    return df.withColumn("_secret", F.lit(key)) if isinstance(key, str) else df.crossJoin(F.broadcast(key.select(F.col("key").alias("_secret"))))


def later_attempts(found: DataFrame, key: DataFrame | str) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate is not theirs alone.

    ``found`` has every distinct (kind, value).  Of those that share a
    surrogate the first by value keeps it; the others, and those whose
    surrogate is itself an entity, try again.  Where numbers fill a quarter of
    their space all of its numbers have attempt -1; elsewhere at most half of
    the space is taken, so every attempt succeeds at least every second time
    and the rounds end.
    """
    space = F.when(F.col("kind") == "ip", F.lit(2.0**28)).otherwise(F.pow(F.lit(10.0), F.col("size")))
    size = F.when(F.col("kind").isin("phone", "ssn"), F.length("value")).when(F.col("kind") == "ip", 0)
    found = found.select("kind", "value", size.alias("size"))
    # at most a row for each length of a telephone number
    full = found.where("size is not null").groupBy("kind", "size").agg(F.count("*").alias("n")).where(F.col("n") * 4 > space).select("kind", "size", F.lit(True).alias("full"))
    held = found.join(F.broadcast(full), ["kind", "size"], "left").select("kind", "value", F.when(F.col("full"), -1).otherwise(0).alias("attempt"))
    held = durable(held)
    dense = held.where("attempt < 0")
    held = held.where("attempt = 0")
    while True:
        made = durable(with_key(held, key).select("kind", "value", "attempt", new_value(F.col("kind"), F.col("value"), F.col("attempt"), F.col("_secret")).alias("new")))
        real = held.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
        made = made.join(real, ["kind", "new"], "left")
        nth = F.row_number().over(Window.partitionBy("kind", "new").orderBy(F.col("attempt") > 0, "value"))
        made = durable(made.withColumn("again", F.col("real").isNotNull() | (nth > 1)).drop("new", "real"))
        if made.where("again").isEmpty():
            return made.where("attempt > 0").select("kind", "value", "attempt").unionByName(dense)
        held = made.withColumn("attempt", F.col("attempt") + F.col("again").cast("int")).drop("again")


def replace_entities(docs: DataFrame, text: str = "text", key: DataFrame | str = "rotate-me", small_rows: int = SMALL_ROWS) -> DataFrame:
    """``docs`` with its entities replaced in ``text``, and ``n_entities``.

    Null texts stay null with 0 entities.  Rows are replaced one by one: equal
    texts give equal texts, long ones are read whole, and an empty table gives
    an empty one.  A column ``n_entities`` of ``docs`` is replaced; others may
    have any name.  ``key`` is a table of one row (key), best read from where
    only the job can read it, or its text.  It is joined as a column, so that
    neither it nor anything derived from it stands in a plan.
    """
    spark = docs.sparkSession
    if isinstance(key, str):
        key = secret_table(spark, hmac.new(key.encode(), b"surrogates", "sha256").hexdigest())
    held = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    t = F.col("_text")
    named = lambda df: df.withColumn("kind", kind_of(F.col("e"))).withColumn("value", value_of(F.col("e"), F.col("kind"))).where("kind <> 'number'")
    each = named(rows.select(F.explode(F.array_distinct(entities(t))).alias("e")))
    later = durable(later_attempts(durable(each.select("kind", "value").distinct()), key))  # texts are read once for them
    n_later = later.count()
    out = with_key(rows, key)
    if n_later == 0:
        attempt = lambda e, x: F.lit(0)
    elif n_later <= small_rows:
        found = later.select(F.concat_ws("\x1f", "kind", "value").alias("k"), "attempt").collect()
        table = F.create_map(*[F.lit(x) for r in found for x in (r.k, r.attempt)])
        attempt = lambda e, x: F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", x["kind"], x["value"])), F.lit(0))
    else:
        marked = named(rows.select(F.unhex(F.md5(t)).alias("_hash"), F.explode(F.array_distinct(entities(t))).alias("e")).distinct())
        maps = marked.join(later, ["kind", "value"]).groupBy("_hash").agg(F.map_from_entries(F.collect_set(F.struct("e", "attempt"))).alias("_later"))
        out = out.withColumn("_hash", F.unhex(F.md5(t))).join(maps, "_hash", "left")
        attempt = lambda e, x: F.coalesce(F.try_element_at(F.col("_later"), e), F.lit(0))

    def surrogate(e: Column) -> Column:
        with_value = lambda k: F.struct(k.alias("kind"), value_of(e, k).alias("value"))
        return let(let(kind_of(e), with_value), lambda x: respelled(e, x["kind"], new_value(x["kind"], x["value"], attempt(e, x), F.col("_secret"))))

    out = out.withColumn("_entities", entities(t))
    put = F.zip_with(F.split(t, ENTITY, -1), F.transform("_entities", surrogate), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    new = F.when(F.size("_entities") > 0, F.array_join(put, "")).otherwise(t)
    n = F.size(F.filter("_entities", lambda e: ~like_card(e) | luhn(digits(e)))).cast("long")
    return out.select(*[(new if c == text else F.col(f"_row.`{c}`")).alias(c) for c in held], n.alias("n_entities"))


def replace_documents(docs: DataFrame) -> DataFrame:
    """``docs`` in its columns, with entities replaced and ``n_chars`` counted anew.

    Every row stays, null, empty, repeated and very long texts included; null
    texts stay null, with null ``n_chars``.
    """
    out = replace_entities(docs).drop("n_entities")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
