"""Personal data replaced by keyed surrogates of the same type and format.

Detection is one pattern; each match has a kind and a canonical form, so that ``+1 (017) 555-7713`` and
``+1 017-555-7713`` are one entity.  A surrogate comes from an HMAC of kind and canonical form: digits stay
digits, letters stay letters of their script and case, punctuation stays, card numbers keep their validity
under the check digit rule, given names keep their gender, and the layout of each mention is kept.  The same
entity gets the same surrogate in every document (coreference).  Collision checks make that one-to-one:
candidates are compared with all entities of the corpus and with each other, and the losers draw again with
the next attempt number until none is left; late attempts are longer, so this ends.  Every step is a
DataFrame function.  What is compared and joined are the distinct entities, not the texts.

A word of a name that its document has elsewhere, in whatever case, is that person again and gets the same surrogate
there.  That needs evidence: one table counts in how many documents each word stands in lower case and how many in
others, and a word that is mostly written small, or a listed function or role word, is replaced nowhere but right behind
a title or in front of or behind a given name.  A word of an e-mail address that is a name of the corpus follows it.  Private, loopback and link-local addresses stay so,
and IBANs keep the validity of their check digits.

Defined results: null and empty texts, and texts without entities, come back as they were.  Repeated rows get
the same result.  Empty tables give empty results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakfield.functions.tokens import hmac_hex
from cloakfield.llm._shared import materialize, table

#: Key of the registered query; real uses pass their own.
DEMO_KEY = "demo-surrogate-key-of-more-than-32-bytes"

# fixed values: titles with their gender, given names with theirs, and the syllables of generated names
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor")
OTHER_TITLES = ("Dr", "Prof")
FEMALE_NAMES = ("Mary", "Anna", "Maria", "Emma", "Julia", "Laura", "Sophie", "Elena", "Claire", "Katharina", "Lucía", "Carmen", "Chloé", "Helen", "Susan", "Linda", "Анна", "Мария", "Елена", "Ольга")
MALE_NAMES = ("James", "John", "Robert", "Michael", "David", "Thomas", "Peter", "Hans", "Jürgen", "Pierre", "Jean", "Luis", "Carlos", "José", "Antonio", "William", "Иван", "Алексей", "Дмитрий", "Сергей")
# fixed values: labels before a colon and words before a name that say that a person follows
LABELS = ("name", "full name", "contact", "author", "patient", "customer", "client", "employee", "applicant", "attn", "signed", "kontakt", "autor", "nom", "nombre")
CUES = ("Dear", "Regards", "Sincerely", "Sehr geehrte", "Sehr geehrter", "Cher", "Chère", "Estimado", "Estimada")
#: Words of function or role, which no label or salutation makes a name.
NO_NAMES = (
    "a an and are as at by dear for from he her his i in is it its madam my no not of on or our she sir that the their they this to we with you your "
    "all administrator agent author board client colleague colleagues committee company customer customers department editor editorial everyone friend friends "
    "group guest hello help hiring manager management member members news office owner press reader readers sales service services staff subscriber support team user users valued "
    "der die das ein eine und sie wir ihr ihre unser unsere kunde kunden kundin damen herren redaktion mannschaft "
    "le la les un une et nous vous notre votre client cliente équipe rédaction tous el los las una nosotros su sus nuestro nuestra equipo redacción todos"
).split()
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge go ha he ho ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо ва ве ви во га го да де ди до за зе зи зо ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи по ра ре ри ро са се си со та те ти то".split(),
}
ENDINGS = {
    ("latin", "female"): ("la", "na", "ra", "lia"),
    ("latin", "male"): ("lus", "nor", "ric", "ton"),
    ("latin", "neutral"): ("rin", "lis", "mar", "del"),
    ("latin", "family"): ("man", "ner", "sen", "well"),
    ("cyrillic", "female"): ("на", "ла", "ра", "ия"),
    ("cyrillic", "male"): ("слав", "мир", "рий", "тин"),
    ("cyrillic", "family"): ("нов", "лев", "рин", "ский"),
    ("cyrillic", "family_f"): ("нова", "лева", "рина", "ская"),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# No pattern repeats a group without a small bound, and none repeats a class by a count without one where lengths of characters
# may differ: Java would recurse once for each repeat.
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_H = "[0-9a-fA-F]{1,4}"
#: Eight groups, or fewer around one gap with two groups at least.
_IP6 = rf"(?<![0-9A-Za-z:.])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|:(?::{_H}){{2,7}})(?![0-9A-Za-z:])"
_PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<!\d)\(0\d{2,4}\) ?\d{4,8}(?!\d)|(?<![\d/.-])0\d{2,4}/\d{5,9}(?![\d/])|(?<![\d.-])0\d{2} \d{3} \d{4}(?![\d.])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
_SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_ACCESS_KEY = r"(?<![\p{L}\p{N}])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\p{L}\p{N}])"
_NAMES = r"(?i:password|passwd|pwd|secret|api[_-]?key|token)"
#: A name in or out of quotes, the separator, and the quote that opens the value.
_ASSIGNED = rf"{_NAMES}(?:[\"']?\s*+[=:]\s*+[\"']?|\s++(?i:is)\s++)"
_IN = r"[^\s\x00\"'<>,;&]"
_VALUE = rf"{_IN}{{5}}{_IN}*[^\s\"'<>,;&.:!?)]"
_DIGIT = r"(?=[^\s\x00\"'<>,;&\d]{0,4096}+\d)"
#: A value of six characters or more right behind its name, in quotes, or behind white space or "is" if it has a digit among
#: its first 4,096 characters, so that prose stays; punctuation that ends a sentence is not part of it.  A value that is a hex secret as a whole is one, but
#: right behind a name other than token.
_CREDENTIAL = (
    rf"(?<![\p{{L}}\p{{N}}])(?:(?!(?i:token)){_NAMES}[=:]{_VALUE}"
    rf"|{_NAMES}[\"']?\s*+[=:]\s*+[\"'](?!{_SECRET}){_VALUE}"
    rf"|{_NAMES}(?:[\"']?\s*+[=:]\s*+|\s++(?i:is)\s++)(?!{_SECRET}){_DIGIT}{_VALUE})"
)
_JWT = r"(?<![\p{L}\p{N}_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
_TITLES = "|".join((*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES))
_GIVEN = "|".join((*FEMALE_NAMES, *MALE_NAMES))
_PART = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
_WORD = rf"{_PART}(?:-{_PART})?"
_LOUD = r"\p{Lu}['’]?\p{Lu}+(?:-\p{Lu}+)?"
_LOUD_GIVEN = _GIVEN.upper()
_OTHER = rf"(?!(?i:{'|'.join(NO_NAMES)})(?!\p{{L}})){_WORD}"
#: A name: a title and one or two capitalised words, a known given name and a capitalised word, either in capitals, or two or
#: three capitalised words behind a word or label that names a person.
_PERSON = (
    rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:{_TITLES})\.? (?:(?:{_WORD} )?{_WORD}|(?:{_LOUD} )?{_LOUD})|(?:{_GIVEN})(?:-(?:{_GIVEN}))? {_WORD}|(?:{_LOUD_GIVEN}) {_LOUD}"
    rf"|(?<=(?<![\p{{L}}\p{{N}}])(?:(?i:{'|'.join(LABELS)}): ?|(?:{'|'.join(CUES)}),?[ \n]))(?!(?:{_TITLES})(?!\p{{L}})){_OTHER} (?:{_OTHER} )?{_OTHER})(?!\p{{L}})"
)
#: Two cheap tests stand before groups of patterns: a word begins here, or something that numbers begin with.
_START, _NUMBER = r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}._%+:-])", r"(?=[\d+(])"
PATTERN = f"{_START}(?:{_CREDENTIAL}|{_EMAIL}|{_IP6})|{_NUMBER}(?:{_IP}|{_PHONE}|{_SSN}|{_CARD})|{_START}(?:{_SECRET}|{_ACCESS_KEY}|{_JWT}|{_IBAN}|{_PERSON})"


def _kind(e: Column) -> Column:
    whole = lambda p: e.rlike(f"^(?:{p})$")
    return (
        F.when(e.rlike(f"^{_ASSIGNED}"), "credential")
        .when(e.startswith("eyJ") & e.contains("."), "jwt")
        .when(e.contains("@"), "email")
        .when(whole("(?:AKIA|ASIA)[0-9A-Z]{16}"), "access_key")
        .when(whole(rf"(?:{_OCTET}\.){{3}}{_OCTET}"), "ip")
        .when(whole("[0-9a-fA-F]*:[0-9a-fA-F:]+"), "ip6")
        .when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(whole(r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}"), "card")
        .when(e.rlike(r"^[+(]|^\d{3}-\d{3}-|^0\d+[/ ]"), "phone")
        .when(whole("[0-9a-f]{32,64}|[0-9A-F]{32,64}"), "secret")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .otherwise("person")
    )


#: Where the words of an address's local part begin and end.
_CUTS = r"(?<=[._%+-])|(?=[._%+-])"


def _units(e: Column) -> Column:
    """The parts of a match that are replaced, as (kind, canonical): one, or one for each word of a name; titles have a null kind."""
    kind = _kind(e)
    country = F.regexp_extract(e, r"^\+\d{1,3}(?=[ .(-])", 0)
    digits = F.regexp_replace(F.substring(e, F.length(country) + 1, F.length(e)), r"\D", "")
    canonical = (
        F.when(kind.isin("email", "secret", "ip6"), F.lower(e))
        .when(kind.isin("card", "ssn"), F.regexp_replace(e, r"\D", ""))
        .when(kind == "phone", F.concat(country, F.lit("/"), digits))
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .when(kind == "credential", F.regexp_replace(e, f"^{_ASSIGNED}", ""))
        .otherwise(e)
    )
    words = F.split(e, " ")
    bare = lambda w: F.regexp_replace(w, r"\.$", "")
    # a name in capitals is the same name
    plain = lambda w: F.when((w == F.upper(w)) & (F.length(w) > 2), F.initcap(F.lower(w))).otherwise(w)
    lead = lambda w: F.substring_index(plain(w), "-", 1)
    first, second = F.get(words, 0), F.coalesce(F.get(words, 1), F.lit(""))
    female = lead(first).isin(*FEMALE_NAMES) | bare(first).isin(*FEMALE_TITLES) | lead(second).isin(*FEMALE_NAMES)
    male = lead(first).isin(*MALE_NAMES) | bare(first).isin(*MALE_TITLES) | lead(second).isin(*MALE_NAMES)
    titled = bare(first).isin(*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES)
    #: what only a label or salutation makes a name
    weak = (kind == "person") & ~titled & ~lead(first).isin(*FEMALE_NAMES, *MALE_NAMES) & ~lead(second).isin(*FEMALE_NAMES, *MALE_NAMES)
    script = lambda w: F.when(w.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def name(w: Column, i: Column) -> Column:
        title = (i == 0) & titled
        last = i == F.size(words) - 1
        family = F.when((script(w) == "cyrillic") & w.rlike("[ая]$"), "family_f").otherwise("family")
        # a given name of no known gender: Cyrillic ones tell it by their ending, Latin ones get a neutral form
        unknown = F.when(script(w) == "cyrillic", F.when(w.rlike("[ая]$"), "female").otherwise("male")).otherwise("neutral")
        role = F.when(last, family).when(female, "female").when(male, "male").otherwise(unknown)
        return F.struct(F.when(~title, F.concat_ws(":", F.lit("name"), script(w), role)).alias("kind"), plain(w).alias("canonical"), w.alias("word"), weak.alias("weak"))

    one = F.array(F.struct(kind.alias("kind"), canonical.alias("canonical"), e.alias("word"), F.lit(False).alias("weak")))
    return F.when(kind == "person", F.transform(words, name)).otherwise(one)


def _stream(key: str, attempt: Column, n: Column) -> Column:
    """Blocks of 64 hex digits, 2n or more together, that depend on the key, the unit and the attempt; an array, so that any byte is reached at once."""
    seed = hmac_hex(F.concat_ws(":", "kind", "canonical", attempt.cast("string")), key)
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor(n / 32).cast("int")), lambda k: F.sha2(F.concat(x, k.cast("string")), 256))
    return F.element_at(F.transform(F.array(seed), blocks), 1)  # the seed is computed once


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(F.get(stream, F.floor(i / 32).cast("int")), 2 * F.pmod(i, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")


def _same_shape(text: Column, stream: Column, hexadecimal: Column, first: Column | None = None) -> Column:
    """Replaces each digit by a digit and each letter by a letter of its script and case; hex digits by hex digits."""
    alphabets = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω")

    def put(c: Column, i: Column) -> Column:
        at = i if first is None else i + first
        of = lambda a: F.substr(F.lit(a), F.pmod(_byte(stream, at), F.lit(len(a))) + 1, F.lit(1))
        return (
            F.when(hexadecimal & c.rlike("^[0-9a-f]$"), of("0123456789abcdef"))
            .when(c.rlike("^[0-9]$"), of(alphabets[0]))
            .when(c.rlike(r"^\p{IsCyrillic}$"), of(alphabets[3]))
            .when(c.rlike(r"^\p{IsGreek}$"), of(alphabets[4]))
            .when(c.rlike(r"^\p{Lu}$"), of(alphabets[2]))
            .when(c.rlike(r"^\p{L}$"), of(alphabets[1]))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), put), "")


def _luhn(digits: Column) -> Column:
    """The sum of the check digit rule, from the right, modulo 10."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when((n - i) % 2 == 0, F.when(2 * d.cast("int") > 9, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _mod97(digits: Column) -> Column:
    """The remainder of a number in which letters stand for 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(digits, ""), F.lit(0), step)


def _iban(c: Column, account: Column) -> Column:
    """Country and account with check digits that are valid where those of ``c`` are."""
    country = F.substring(c, 1, 2)
    valid = _mod97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1
    digits = F.lit(98) - _mod97(F.concat(account, country, F.lit("00"))) + F.when(valid, 0).otherwise(1)
    return F.concat(country, F.lpad(digits.cast("string"), 2, "0"), account)


def _address(c: Column, s: Column, attempt: int) -> Column:
    """An IPv4 address of the same reach: private, loopback and link-local ones stay so; small private blocks that are used up go on in the large one."""
    byte = lambda i: F.pmod(_byte(s, F.lit(i)), F.lit(254)) + 1
    put = lambda *parts: F.concat_ws(".", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    private = put("10", byte(1), byte(2), byte(3))
    spread = [F.lit(x) for x in range(1, 224) if x not in (10, 127, 169, 172, 192)]
    if attempt >= 8:
        return F.when(c.rlike(r"^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\."), private).otherwise(put(F.element_at(F.array(*spread), F.pmod(_byte(s, F.lit(0)), F.lit(len(spread))) + 1), byte(1), byte(2), byte(3)))
    return (
        F.when(c.startswith("10."), private)
        .when(c.startswith("127."), put("127", byte(1), byte(2), byte(3)))
        .when(c.startswith("192.168."), put("192", "168", byte(2), byte(3)))
        .when(c.startswith("169.254."), put("169", "254", byte(2), byte(3)))
        .when(c.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\."), put("172", F.pmod(_byte(s, F.lit(1)), F.lit(16)) + 16, byte(2), byte(3)))
        .otherwise(put(F.element_at(F.array(*spread), F.pmod(_byte(s, F.lit(0)), F.lit(len(spread))) + 1), byte(1), byte(2), byte(3)))
    )


def _candidates(units: DataFrame, key: str, attempt: int) -> DataFrame:
    """Adds surrogate, the canonical form of the replacement at this attempt."""
    a = F.lit(attempt)
    more = F.lit(max(0, attempt - 7))  # characters by which late attempts are longer
    s = F.col("__stream")
    df = units.withColumn("__stream", _stream(key, a, F.length("canonical") + more + 8))
    c = F.col("canonical")
    cut = F.instr(c, "@")
    local = F.substring(c, F.lit(1), cut - 1)
    host, top = F.substring_index(F.substring(c, cut + 1, F.length(c)), ".", 1), F.regexp_extract(c, r"@[^.]*(\..*)$", 1)
    local = F.concat(local, F.repeat(F.lit("x"), more))
    # words of the address that are names of the corpus follow their persons' surrogates
    shaped = _same_shape(local, s, F.lit(False))
    followed = F.array_join(F.zip_with(F.split(shaped, _CUTS), "named", lambda x, n: F.coalesce(n, x)), "")
    email = F.concat(F.when(F.col("named").isNotNull(), followed).otherwise(shaped), F.lit("@"), _same_shape(host, s, F.lit(False), F.length(local)), top)
    octets = _address(c, s, attempt)
    # the first group says what reach an address has, and stays
    scope = F.substring_index(c, ":", 1)
    if attempt < 8:
        groups = F.concat(scope, _same_shape(F.substring(c, F.length(scope) + 1, F.length(c)), s, F.lit(True)))
    else:
        groups = F.concat(F.when(scope == "", "fd00").otherwise(scope), *[x for i in range(7) for x in (F.lit(":"), F.substr(F.get(s, 0), F.lit(4 * i + 1), F.lit(4)))])
    country = F.substring_index(c, "/", 1)
    number = F.concat(F.substring_index(c, "/", -1), F.repeat(F.lit("0"), more))
    phone = F.concat(country, F.lit("/"), _same_shape(number, s, F.lit(False)))
    card = F.concat(c, F.repeat(F.lit("0"), more))
    card = _same_shape(card, s, F.lit(False))
    # the last digit is moved by the difference, so a valid number stays valid and an invalid one invalid
    off = F.pmod(_luhn(c) - _luhn(card), F.lit(10))
    card = F.concat(F.substring(card, F.lit(1), F.length(card) - 1), F.pmod(F.substring(card, F.length(card), F.lit(1)).cast("int") + off, F.lit(10)).cast("string"))
    iban = _iban(c, _same_shape(F.concat(F.substring(c, F.lit(5), F.length(c)), F.repeat(F.lit("0"), more)), s, F.lit(False)))
    access_key = F.concat(F.substring(c, 1, 4), _same_shape(F.concat(F.substring(c, F.lit(5), F.length(c)), F.repeat(F.lit("0"), more)), s, F.lit(False)))
    # passwords are often hex digits too, and then stay so
    shape = (F.col("kind") == "secret") | (F.col("kind") == "credential") & c.rlike(r"^(?=.*[a-f])[0-9a-f]+$")
    tail = F.concat(c, F.repeat(F.lit("0"), more))
    other = F.element_at(F.transform(F.array(shape), lambda x: _same_shape(tail, s, x)), 1)  # the test is made once, not for each character
    name = F.lit(None).cast("string")
    for (script, role), ends in ENDINGS.items():
        table_ = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        end = F.array(*[F.lit(x) for x in ends])
        body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1 + min(attempt, 30) // 3)), lambda i: F.element_at(table_, F.pmod(_byte(s, i), F.size(table_)) + 1)), "")
        made = F.initcap(F.concat(body, F.element_at(end, F.pmod(_byte(s, F.lit(15)), F.lit(len(ends))) + 1)))
        # a double name stays one
        second = F.initcap(F.concat(*[F.element_at(table_, F.pmod(_byte(s, F.lit(i)), F.size(table_)) + 1) for i in (20, 21)], F.element_at(end, F.pmod(_byte(s, F.lit(22)), F.lit(len(ends))) + 1)))
        made = F.when(c.contains("-"), F.concat(made, F.lit("-"), second)).otherwise(made)
        name = F.when(F.col("kind") == f"name:{script}:{role}", made).otherwise(name)
    surrogate = (
        F.when(F.col("kind") == "email", email)
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "ip6", groups)
        .when(F.col("kind") == "phone", phone)
        .when(F.col("kind") == "card", card)
        .when(F.col("kind") == "iban", iban)
        .when(F.col("kind") == "access_key", access_key)
        .when(F.col("kind").startswith("name:"), name)
        .otherwise(other)
    )
    return df.withColumn("surrogate", surrogate).drop("__stream")


def assign(units: DataFrame, key: str) -> DataFrame:
    """Rows (kind, canonical, surrogate) for distinct units: one-to-one within a kind, and never an entity of the corpus.

    One round settles nearly all; the loop runs while units are left, each round over those alone, and late rounds draw
    longer surrogates, of which there are always enough.  A column ``named`` may hold, for an e-mail address, what words
    of its local part become.
    """
    if "named" not in units.columns:
        units = units.withColumn("named", F.lit(None).cast("array<string>"))
    originals = units.select("kind", F.col("canonical").alias("surrogate"))
    settled: list[DataFrame] = []
    left = units
    for attempt in count():
        drawn = _candidates(left, key, attempt).join(originals, ["kind", "surrogate"], "left_anti")
        for table_ in settled:
            drawn = drawn.join(table_.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialize(drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")), "surrogates")
        settled.append(won)
        left = materialize(left.join(won.select("kind", "canonical"), ["kind", "canonical"], "left_anti"), "surrogates-left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, settled)
    raise AssertionError("not reached")


def _assign_all(units: DataFrame, key: str) -> DataFrame:
    """Surrogates of all units: names first, since the words of e-mail addresses that are names follow them."""
    is_name = F.col("kind").startswith("name:")
    names = assign(units.where(is_name), key)
    words = names.where(F.length("canonical") > 2).groupBy(F.lower("canonical").alias("word")).agg(F.lower(F.min("surrogate")).alias("new"))
    parts = units.where("kind = 'email'").select("canonical", F.posexplode(F.split(F.substring_index("canonical", "@", 1), _CUTS)).alias("i", "word"))
    named = parts.join(words, "word").groupBy("canonical").agg(F.collect_list(F.struct("i", "new")).alias("found"))
    n = F.size(F.split(F.substring_index("canonical", "@", 1), _CUTS))
    at = lambda i: F.element_at(F.filter("found", lambda x: x["i"] == i), 1)
    named = named.select("canonical", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.exists("found", lambda x: x["i"] == i), at(i)["new"])).alias("named"))
    return names.unionByName(assign(units.where(~is_name).join(named, "canonical", "left"), key))


def _render(match: Column, kind: Column, surrogate: Column) -> Column:
    """Puts a surrogate into the layout of a mention: digits in their places for numbers, letter case for the rest."""
    country = F.when(kind == "phone", F.regexp_extract(match, r"^\+\d{1,3}(?=[ .(-])", 0)).otherwise("")
    rest = F.substring(match, F.length(country) + 1, F.length(match))
    new = F.substring_index(surrogate, "/", -1)
    taken = lambda c: F.when(kind == "iban", c.rlike("[A-Z0-9]")).otherwise(c.rlike("[0-9]"))
    step = lambda acc, c: F.when(
        taken(c), F.struct(F.concat(acc["out"], F.substr(new, acc["i"] + 1, F.lit(1))).alias("out"), (acc["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i")))
    laid = F.aggregate(F.split(rest, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda acc: F.concat(acc["out"], F.substr(new, acc["i"] + 1, F.length(new))))
    numbers = kind.isin("phone", "card", "ssn", "iban")
    upper = F.when((match == F.upper(match)) & (match != F.lower(match)), F.upper(surrogate)).otherwise(surrogate)
    named = F.concat(F.regexp_extract(match, f"^{_ASSIGNED}", 0), surrogate)
    return F.when(numbers, F.concat(country, laid)).when(kind == "credential", named).otherwise(upper)


def _small_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Those of ``words`` (word, in lower case) that more documents have in lower case than otherwise, and the listed ones."""
    seen = F.array_distinct(F.split(F.coalesce(F.col("text"), F.lit("")), r"[^\p{L}\p{N}'’-]+"))
    each = docs.select(F.explode(F.filter(seen, lambda w: w.rlike(r"^\p{L}"))).alias("w"))
    counts = each.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w") == F.lower("w")).alias("small"), F.count_if(F.col("w") != F.lower("w")).alias("large"))
    found = words.join(counts, "word", "left").where((F.col("small") > F.col("large")) | F.col("word").isin(*NO_NAMES))
    return found.select("word")


def pii_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """Rows (doc_id, text, n_entities, kinds): texts with every detected entity replaced, how many there were, and of which kinds.

    Entities meet their surrogates in a join on the entity, whose many-mentions side Spark splits when it is
    skewed; texts are shuffled once, by document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select("doc_id", "text", F.xxhash64(text).alias("mark"))
    found = marked.select("doc_id", "mark", F.regexp_extract_all("text", F.lit(PATTERN), 0).alias("matches"))
    found = materialize(found.where(F.size("matches") > 0).dropDuplicates(["doc_id", "mark"]), "pii-found")
    mentions = found.select("doc_id", "mark", F.posexplode("matches").alias("pos", "match"))
    mentions = mentions.select("doc_id", "mark", "pos", "match", F.posexplode(_units(F.col("match"))).alias("part", "unit"))
    mentions = materialize(mentions.select("doc_id", "mark", "pos", "match", "part", "unit.*"), "pii-mentions")
    spoken = mentions.where(F.startswith("kind", F.lit("name:"))).select(F.lower("canonical").alias("word")).distinct()
    small = materialize(_small_words(docs, spoken), "pii-words").withColumn("small", F.lit(True))
    mentions = mentions.join(small.withColumnRenamed("word", "__small"), F.lower("canonical") == F.col("__small"), "left").drop("__small")
    mentions = mentions.withColumn("small", F.coalesce("small", F.lit(False)))
    # a name by label alone with a word that is mostly written small is none
    none = F.max(F.col("weak") & F.col("small")).over(Window.partitionBy("doc_id", "mark", "pos"))  # the words of a match
    mentions = mentions.withColumn("none", none).withColumn("kind", F.when(~F.col("none"), F.col("kind"))).drop("none", "weak")
    mentions = mentions.withColumn("canonical", F.when(F.col("kind").isNull(), F.col("word")).otherwise(F.col("canonical")))
    units = materialize(mentions.where(F.col("kind").isNotNull()).select("kind", "canonical").distinct(), "pii-units")
    surrogates = _assign_all(units, key)
    drawn = mentions.join(surrogates, ["kind", "canonical"], "left")
    is_name = F.coalesce(F.startswith("kind", F.lit("name:")), F.lit(False))
    piece = F.when(F.col("kind").isNull(), F.col("canonical")).otherwise(_render(F.when(is_name, F.col("word")).otherwise(F.col("match")), F.col("kind"), F.col("surrogate")))
    # a zero character, which no entity holds, stands before the first part of each entity, so that one string has them all
    piece = F.concat(F.when(F.col("part") == 0, "\0").otherwise(" "), piece)
    name = F.when(is_name & ~F.col("small"), F.struct(F.lower("canonical").alias("canonical"), "surrogate"))
    drawn = drawn.select("doc_id", "mark", "pos", F.when(F.col("kind").isNotNull(), F.col("pos")).alias("hit"), "part", piece.alias("piece"), F.substring_index("kind", ":", 1).alias("kind"), name.alias("name"))
    parts = drawn.groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_list(F.struct("pos", "part", "piece"))).alias("pieces"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.sort_array(F.collect_set("name")).alias("names"),
        F.size(F.collect_set("hit")).alias("hits"),
    )
    new = F.split(F.array_join(F.transform("pieces", lambda x: x["piece"]), ""), "\0")
    ready = parts.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__m"), "kinds", "names", "hits", F.concat(F.slice(new, F.lit(2), F.size(new)), F.array(F.lit(""))).alias("new"))
    joined = marked.join(ready, marked["doc_id"].eqNullSafe(ready["__id"]) & (F.col("mark") == F.col("__m")), "left")
    joined = joined.withColumn("__between", F.when(F.col("new").isNotNull(), F.split("text", PATTERN, -1)))
    old = F.transform("names", lambda x: x["canonical"])
    bare = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(old, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    styled = lambda w, new: F.when(w == F.lower(w), F.lower(new)).when((w == F.upper(w)) & (F.length(w) > 1), F.upper(new)).otherwise(new)
    named = F.size("names") > 0

    def again(x: Column) -> Column:
        """The text between two entities, where words of the document's names stand alone."""
        found = F.transform(F.regexp_extract_all(x, bare, F.lit(0)), lambda w: styled(w, F.try_element_at("names", F.array_position(old, F.lower(w)).cast("int"))["surrogate"]))
        return F.when(named, F.array_join(F.zip_with(F.split(x, bare, -1), F.concat(found, F.array(F.lit(""))), lambda y, z: F.concat(y, z)), "")).otherwise(x)

    woven = F.array_join(F.zip_with(F.transform("__between", again), "new", lambda x, y: F.concat(x, y)), "")
    more = F.when(named, F.aggregate("__between", F.lit(0), lambda a, x: a + F.regexp_count(x, bare))).otherwise(0)
    n = F.when(F.col("new").isNull(), 0).otherwise(F.col("hits") + more)
    return joined.select("doc_id", F.when(F.col("new").isNull(), F.col("text")).otherwise(woven).alias("text"), n.cast("bigint").alias("n_entities"), F.array_join(F.coalesce("kinds", F.array()), ",").alias("kinds"))


def query(spark, sf_dir):
    return pii_surrogates(table(spark, sf_dir, "documents"), DEMO_KEY)
