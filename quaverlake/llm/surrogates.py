"""Surrogates for personal data: every detected entity gets a keyed replacement of its own type.

Entities are e-mail addresses, phone numbers, payment card numbers, bank account numbers (IBAN), social security numbers, IPv4 and IPv6 addresses, secrets (long hex strings and common key
forms) and names after a title, also all in capitals, with the later and earlier bare mentions of these names in the same text. A replacement depends on a secret key, the type and the entity's canonical form, so that an
entity has the same surrogate wherever and however it is written (coreference). Surrogates keep the format: length, punctuation,
letter case, the script of letters, a phone's country code, an address's top-level domain and shared domains, the digits of an octet within 0-255, a card's first
digit and whether its check digit holds, an account number's country and whether its check digits hold. Names keep the title, its gender, the script and the number of parts; a surname alone and with a given name
has the same surrogate. Names of Latin, Cyrillic and Greek letters are made of syllables and an ending
that tells their gender; names of other scripts get letters of their own script, which say no gender.

Collision checks. Two entities of a type never share a surrogate, no surrogate is an entity of the corpus and none contains its original: losers are keyed anew
with the next attempt until none is left. Where a format is too small for that, surrogates may after `STRICT` attempts be other entities, and after
`ATTEMPTS` get further characters.

Everything is DataFrame functions. The patterns read each text once; what they find is staged. Only texts with entities are shuffled, and distinct entities are what is compared; a hot entity is reduced
before the shuffle, and copies of one text meet what replaces their entities in `SALTS` groups.

Defined results: a null or empty text has no entities and stays as it is. Rows, their repeats and all other columns, whatever their names, are kept; `n_entities` (what the patterns find, without
bare mentions) is added and replaces a column of that name. A bare mention is a whole word, written as in the name, in capitals or with a capital first letter; of a script without spaces, the name of two letters or more anywhere. A word that
stands in several names of a text goes with the first. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, table, uncut

KEY = "surrogates-1"
STRICT, ATTEMPTS = 6, 12
#: Attempts that are worked out at once.
AHEAD = 3
#: Groups that the copies of one text are dealt into.
SALTS = 64

#: Titles by gender.
TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία"], "n": ["Dr", "Prof"]}
#: Names are made of syllables, a consonant and a vowel each, and an ending that tells a surname or the gender of a given name. Five syllables and an ending make 2e10 names of a kind.
SOUNDS = {"Latin": ("bdfghklmnprstvwz", "aeiou"), "Cyrillic": ("бвгдзклмнпрстфхш", "аеиоу"), "Greek": ("βγδζκλμνπρστφχψ", "αεηιο")}
ENDINGS = {
    "Latin": {"surname": ["mann", "berg", "sen", "dal", "wick", "strom"], "m": ["n", "rt", "ld", "k", "do", "no"], "f": ["na", "lia", "ra", "ssa", "nne", "tta"], "n": ["l", "x", "ri", "m", "y", "s"]},
    "Cyrillic": {"surname": ["енко", "ук", "дзе", "вич", "ман", "берг"], "m": ["н", "рт", "д", "слав", "мир", "к"], "f": ["на", "ля", "ра", "ша", "та", "я"], "n": ["ль", "м", "с", "й", "р", "кс"]},
    "Greek": {"surname": ["ακης", "ιδης", "ογλου", "εας", "ουλας", "ατος"], "m": ["νος", "ρος", "λος", "στος", "κος", "δας"], "f": ["να", "ρα", "λη", "νη", "σα", "τα"], "n": ["ξ", "ρ", "λι", "ν", "ψ", "μι"]},
}
LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Ranges of scripts, and the range that a character of each is replaced from. Characters of other scripts become basic Latin letters.
SCRIPTS = [
    ("ª", "ɏ", "ß", "ſ"), ("Ḁ", "ỿ", "ḁ", "ẕ"), ("Ͱ", "Ͽ", "α", "ω"), ("ἀ", "῿", "α", "ω"), ("Ѐ", "ԯ", "а", "џ"), ("԰", "֏", "ա", "ֆ"),
    ("֐", "׿", "א", "ת"), ("؀", "ݿ", "ب", "ي"), ("ऀ", "ॿ", "क", "ह"), ("ঀ", "৿", "ক", "হ"), ("஀", "௿", "க", "ஹ"), ("฀", "๿", "ก", "ฮ"), ("Ⴀ", "ჿ", "ა", "ჰ"),
    ("぀", "ゟ", "あ", "ん"), ("゠", "ヿ", "ア", "ン"), ("㐀", "鿿", "一", "仾"), ("가", "힯", "가", "곾"),
]


def _pool(first: str, last: str) -> str:
    """The small or caseless letters of a range."""
    return "".join(c for c in map(chr, range(ord(first), ord(last) + 1)) if c.isalpha() and c == c.lower() and len(c.upper()) == 1)


_TITLE = "(?:" + "|".join(x for xs in TITLES.values() for x in [*xs, *(x.upper() for x in xs)]) + r")\.?"
_MIXED = "(?:" + "|".join(x for xs in TITLES.values() for x in xs) + r")\.?"
_CAPITALS = "(?:" + "|".join(x.upper() for xs in TITLES.values() for x in xs) + r")\.?"
_WORD = r"[\p{L}\p{M}\p{N}_.%+-]"
_LABEL = r"[\p{L}\p{M}\p{N}-]++"
#: Marks inside a name; an apostrophe that begins a possessive s does not belong to it.
_INNER = r"['’](?=\p{L})(?![sS](?![\p{L}\p{M}]))|-(?=\p{L})"
#: Scripts that put no spaces between words, of which a name is at most so long.
_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_PART = rf"(?:\p{{Lu}}(?:[\p{{L}}\p{{M}}]|{_INNER})++|[{_DENSE}]{{1,40}}+|[\p{{Lo}}&&[^{_DENSE}]][\p{{Lo}}\p{{M}}&&[^{_DENSE}]]*+)"
_CAPITAL = rf"\p{{Lu}}(?:[\p{{Lu}}\p{{M}}]|{_INNER})++(?!\p{{L}})"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: No letter or digit stands next to it.
_BARE = r"[\p{L}\p{M}\p{N}]"
PATTERNS = {
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_MIXED} {{1,3}}{_PART}(?: {_PART})?|{_CAPITALS} {{1,3}}{_CAPITAL}(?: {_CAPITAL})?)",
    "email": rf"(?<!{_WORD}){_WORD}++@{_LABEL}(?:\.{_LABEL}){{1,126}}+",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk|gh[opsur]|github_pat|glpat|xox[abprs])[-_](?:[A-Za-z0-9]{1,15}[-_]){0,4}[A-Za-z0-9]{16,}+(?:[-_][A-Za-z0-9]++)*+)(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])(?=[A-Z]{2}(?:[A-Z ]*\d){8})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:])(?=[A-Fa-f:]*\d)(?:{_GROUP}(?::{_GROUP}){{7}}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![\p{{L}}\p{{N}}:])",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\p{L}\p{N}.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d.-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these has no entity.
HINT = rf"[0-9@]|(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLE} |AKIA|ASIA)|(?<!\p{{L}})(?:sk|pk|rk|gh[opsur]|github_pat|glpat|xox[abprs])[-_][A-Za-z0-9]|[a-fA-F]{{32}}"


#: What a surrogate is made of.
TRIED = ["kind", "form", "attempt", "stream", "alike", "top", "local_size"]


def _let(value: Column, body) -> Column:
    """body(value), evaluated as it stands: for entities, which are few, wide expressions are not worth generated code, whose compilation takes memory of the driver."""
    return F.transform(F.array(value), body)[0]


def _kind(e: Column) -> Column:
    out = F.lit("card")
    for kind in ("ssn", "ip", "phone", "ip6", "iban", "secret", "email", "name"):
        out = F.when(e.rlike(rf"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _units(e: Column, kind: Column) -> Column:
    """The parts of an entity that get surrogates of their own, as (kind, form, word of a name): a name has a surname and perhaps a given name, all else is one part."""
    words = F.split(F.regexp_replace(e, rf"^{_TITLE} +", ""), " ")
    gender = F.when(e.rlike(rf"(?iu)^(?:{'|'.join(TITLES['m'])})\.? "), "m").when(e.rlike(rf"(?iu)^(?:{'|'.join(TITLES['f'])})\.? "), "f").otherwise("n")
    first = F.substring(F.element_at(words, -1), 1, 1)
    script = F.when(first.rlike(r"\p{IsLatin}"), "Latin").when(first.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(first.rlike(r"\p{IsGreek}"), "Greek").otherwise("Other")
    unit = lambda k, form, word: F.struct(k.alias("kind"), form.alias("form"), word.alias("word"))
    surname = unit(F.concat(F.lit("surname."), script), F.lower(F.element_at(words, -1)), F.element_at(words, -1))
    given = unit(F.concat(F.lit("given."), script, F.lit("."), gender), F.lower(words[0]), words[0])
    form = F.when(kind.isin("card", "ssn"), _digits(e)).when(kind == "phone", F.concat(F.when(e.startswith("+"), "+").otherwise(""), _digits(e))).when(kind == "iban", F.lower(F.replace(e, F.lit(" "), F.lit("")))).otherwise(F.lower(e))
    return F.when(kind == "name", F.when(F.size(words) > 1, F.array(given, surname)).otherwise(F.array(surname))).otherwise(F.array(unit(kind, form, F.lit(None).cast("string"))))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte, from 0, of a string of 256 hex digits, which is used again from its start after 128 bytes."""
    return F.conv(stream.substr((i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.lit(alphabet).substr(n % len(alphabet) + 1, F.lit(1))


def _stream(key: str, *parts: Column) -> Column:
    seed = F.concat_ws("|", F.lit(key), *parts)
    return F.concat(F.sha2(F.concat(seed, F.lit("|0")), 512), F.sha2(F.concat(seed, F.lit("|1")), 512))


def _alike(text: Column, stream: Column, hexadecimal: Column, base: Column, base_at: Column) -> Column:
    """Each letter by one of its script, each digit by a digit; ASCII punctuation stays. From `base_at` on the bytes are those of `base`."""

    def one(c: Column, i: Column) -> Column:
        b = F.when(i < base_at, _byte(stream, i)).otherwise(_byte(base, i - base_at))
        out = F.when(hexadecimal & (c.between("0", "9") | c.between("a", "f")), _pick("0123456789abcdef", b)).when(c.between("0", "9"), _pick("0123456789", b)).when(c.between("a", "z"), _pick(LATIN, b)).when(c <= "\x7f", c)
        for low, high, first, last in SCRIPTS:
            out = out.when(c.between(low, high), _pick(_pool(first, last), b))
        return out.otherwise(_pick(LATIN, b))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum that a payment card's digits must have as a multiple of ten."""
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), lambda c, i: (c.cast("int") * (1 + i % 2)) % 10 + F.when((i % 2 == 1) & (c.cast("int") >= 5), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder that an account number's check digits depend on, letters counting from 10."""
    value = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 87)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: value(a, c) % 97)


def _iban(form: Column, alike: Column, b: Column) -> Column:
    """The country and check digits that hold exactly if those of the original do."""
    country, body = F.substring(form, 1, 2), F.substring(alike, F.lit(5), F.length(form))
    right = 98 - _mod97(F.concat(body, country, F.lit("00")))
    holds = _mod97(F.concat(F.substring(form, F.lit(5), F.length(form)), F.substring(form, 1, 4))) == 1
    check = F.when(holds, right).otherwise((right - 1 + b % 90) % 97 + 2)
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def _name(kind: Column, attempt: Column, stream: Column) -> Column:
    """A name of the script and role in `kind`, longer with each attempt."""
    parts = F.split(kind, r"\.")
    script, role = parts[1], F.coalesce(F.get(parts, F.lit(2)), F.lit("surname"))
    known = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])[script]
    consonants, vowels = (known({k: F.lit(v[i]) for k, v in SOUNDS.items()}) for i in (0, 1))
    ends = F.create_map(*[x for k, v in ENDINGS.items() for r, w in v.items() for x in (F.lit(f"{k}.{r}"), F.lit(" ".join(w)))])[F.concat(script, F.lit("."), role)]
    last = F.when(attempt == 0, 1).when(attempt == 1, 2).otherwise(4)
    syllable = lambda i: F.concat(consonants.substr(_byte(stream, 2 * i) % 16 + 1, F.lit(1)), vowels.substr(_byte(stream, 2 * i + 1) % 5 + 1, F.lit(1)))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), last), syllable), ""), F.split(ends, " ")[_byte(stream, F.lit(20)) % 6])


def _tried(todo: DataFrame, key: str) -> DataFrame:
    """(type, kind, form, attempt) with the surrogate of that attempt."""
    kind, form, attempt = F.col("kind"), F.col("form"), F.col("attempt")
    rows = todo.withColumns({"stream": _stream(key, kind, form, attempt.cast("string")), "domain": F.substring_index(form, "@", -1)})
    rows = rows.withColumns({"base": _stream(key, F.lit("domain"), F.col("domain")), "top": F.element_at(F.split("domain", r"\."), -1), "local_size": F.when(kind == "email", F.length(form) - F.length("domain")).otherwise(1 << 30)})  # with the @
    body = F.when(kind == "email", F.substring(form, F.lit(1), F.length(form) - F.length("top") - 1)).otherwise(form)
    rows = rows.withColumn("alike", _alike(body, F.col("stream"), F.coalesce((kind == "ip6") | (kind == "secret") & form.rlike("^[0-9a-f]+$"), F.lit(False)), F.col("base"), F.col("local_size")))
    return rows.select("type", "kind", "form", "attempt", _let(F.struct(*TRIED), _surrogate).alias("surrogate"))


def _surrogate(row: Column) -> Column:
    kind, form, attempt, stream, alike, top, local_size = (row[c] for c in TRIED)
    is_email = kind == "email"
    name_of = F.translate(F.substring(stream, 129, 12), "0123456789", "ghijklmnop")
    # A local part of marks alone has nothing to vary, so it gets letters after all attempts.
    email = F.concat(F.when(attempt < ATTEMPTS, alike).otherwise(F.concat(name_of, F.substring(alike, local_size, F.length(alike)))), F.lit("."), top)
    # The country code is one digit in North America and Russia, else two.
    code = F.when(form.rlike(r"^\+[17]"), 2).when(form.startswith("+"), 3).otherwise(0)
    phone = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(i < code, c).when(i == code, _pick("23456789", _byte(stream, i))).otherwise(_pick("0123456789", _byte(stream, i)))), "")
    octet = lambda o, i: F.when(F.length(o) == 1, _byte(stream, i) % 10).when(F.length(o) == 2, 10 + _byte(stream, i) % 90).otherwise(100 + _byte(stream, i) % 156).cast("string")
    ip = F.array_join(F.transform(F.split(form, r"\."), octet), ".")
    body = F.concat(F.substring(form, 1, 1), F.substring(alike, F.lit(2), F.length(form) - 2))
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, F.when(_luhn(form) % 10 == 0, check).otherwise((check + 1 + _byte(stream, F.lit(100)) % 9) % 10).cast("string"))
    out = F.when(kind == "email", email).when(kind == "secret", alike).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", card).when(kind.isin("ssn", "surname.Other") | kind.startswith("given.Other"), alike)
    out = out.when(kind == "ip6", alike).when(kind == "iban", _iban(form, alike, _byte(stream, F.lit(100)))).otherwise(_name(kind, attempt, stream))
    longer = F.when((attempt < ATTEMPTS) | is_email, "").when(kind.isin("phone", "card", "ssn", "ip", "iban"), F.translate(F.substring(stream, 129, 12), "abcdef", "012345")).when(kind == "ip6", F.concat(F.lit(":"), F.substring(stream, 129, 4))).otherwise(name_of)
    return F.concat(out, longer)


def assign(units: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, form, surrogate) for distinct (kind, form), after the collision checks. All parts of names are of one type."""
    kind_of = F.when(F.col("kind").rlike("^(given|surname)"), "name").otherwise(F.col("kind"))
    originals = cut(units.select("kind", "form").distinct().withColumn("type", kind_of))
    done, todo, attempt = None, cut(originals), 0
    while True:
        if attempt % AHEAD == 0:
            # Some attempts at once: what the rounds after this read is a table.
            ahead = F.explode(F.sequence(F.lit(attempt), F.lit(attempt + AHEAD - 1)))
            tries = cut(_tried(todo.withColumn("attempt", ahead), key).where(~F.contains("surrogate", "form")))
        tried = tries.where(F.col("attempt") == attempt).join(todo.select("kind", "form"), ["kind", "form"], "left_semi")
        # Of those that chose the same surrogate the first form keeps it, unless an earlier round gave it away.
        first = tried.groupBy("type", "surrogate").agg(F.min(F.struct("form", "kind")).alias("winner"))
        if attempt < STRICT:
            first = first.join(originals.select("type", F.col("form").alias("surrogate")), ["type", "surrogate"], "left_anti")
        if done is not None:
            first = first.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        won = first.select("type", "winner.kind", "winner.form", "surrogate")
        before = [x for x in (done, todo) if x is not None]
        done = cut(won if done is None else done.unionByName(won))
        todo = cut(originals.join(done, ["kind", "form"], "left_anti"))
        uncut(*before)
        attempt += 1
        over = todo.isEmpty()
        if over or attempt % AHEAD == 0:
            uncut(tries)
        if over:
            uncut(todo, originals)
            return done.select("kind", "form", "surrogate")


def _poured(e: Column, kind: Column, parts: Column) -> Column:
    """An entity's surrogate in the format in which the entity is written. parts: its units' surrogates."""
    one = parts[0]
    start = F.struct(F.lit("").alias("out"), F.upper(F.regexp_replace(one, r"^\+", "")).alias("rest"))
    # Letters of an account number are replaced like its digits; the other forms have none.
    written = lambda c: c.between("0", "9") | (c.between("A", "Z") & (kind == "iban"))
    by_digit = F.aggregate(
        F.split(e, ""), start,
        lambda s, c: F.when(written(c), F.struct(F.concat(s["out"], F.substring(s["rest"], 1, 1)).alias("out"), F.substring(s["rest"], 2, 100).alias("rest"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["rest"].alias("rest"))),
        lambda s: F.concat(s["out"], s["rest"]),
    )
    cased = F.array_join(F.transform(F.split(one, ""), lambda c, i: F.when(F.substring(e, i + 1, F.lit(1)) != F.lower(F.substring(e, i + 1, F.lit(1))), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(e, rf"^{_TITLE} +", 0)
    names = F.array_join(F.transform(parts, lambda p: F.initcap(p)), " ")
    return F.when(kind == "name", F.concat(title, F.when(F.upper(e) == e, F.upper(names)).otherwise(names))).when(kind.isin("phone", "card", "ssn", "iban"), by_digit).when(kind.isin("email", "secret") & (F.length(one) == F.length(e)), cased).otherwise(one)


def _marked(text: Column, pattern: Column, mark: Column) -> Column:
    """The text cut at the matches: what lies between them and the matches by turns."""
    return F.split(F.regexp_replace(text, pattern, F.concat(mark, F.lit("$0"), mark)), mark, -1)


def _mentions(text: Column, names: Column, mark: Column) -> Column:
    """The text with surrogates for bare mentions. names: (word, surrogate), none twice."""
    forms = F.array_distinct(F.flatten(F.transform(names, lambda x: F.array(x["word"], F.upper(x["word"]), F.initcap(F.lower(x["word"]))))))
    longest = lambda words: F.array_join(F.array_sort(words, lambda a, b: F.length(b) - F.length(a)), "|")
    spaced = F.filter(forms, lambda w: ~w.rlike(r"^\p{Lo}") & (F.length(w) > 1))
    joined = F.filter(forms, lambda w: w.rlike(r"^\p{Lo}") & (F.length(w) > 1))
    with_case = F.when(F.size(spaced) > 0, F.concat(F.lit(rf"(?<!{_BARE})(?:"), longest(spaced), F.lit(rf")(?!{_BARE})")))
    caseless = F.when(F.size(joined) > 0, longest(joined))
    by_form = F.map_from_entries(F.transform(names, lambda x: F.struct(F.lower(x["word"]), x["surrogate"])))

    def told(word: Column) -> Column:
        new = F.element_at(by_form, F.lower(word))
        return F.coalesce(F.when(F.upper(word) == word, F.upper(new)).otherwise(F.initcap(new)), word)

    pieces = _marked(text, F.concat_ws("|", with_case, caseless), mark)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, told(p)).otherwise(p)), "")


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    docs = docs.drop("n_entities")
    text = F.col(f"row.{text_col}")
    # A mark that the text does not hold.
    mark = F.when(F.contains(text, F.lit("\x01")), F.concat(F.lit("\x01"), F.sha2(text, 256))).otherwise("\x01")
    # The row is one column, so that no column of the input clashes with those made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("pieces", F.when(text.rlike(HINT), _marked(text, F.lit(ENTITY), mark))).withColumn("pieces", F.when(F.size("pieces") > 1, F.col("pieces")))
    # What replaces a text's entities depends on the text alone, so it is made once for equal texts.
    staged = cut(rows.withColumns({"key": F.when(F.col("pieces").isNotNull(), F.sha2(text, 256)), "salt": F.monotonically_increasing_id() % SALTS}))
    with_some = staged.where("pieces is not null")
    found = with_some.select("key", F.filter("pieces", lambda p, i: i % 2 == 1).alias("all")).dropDuplicates(["key"])
    each = found.select("key", F.posexplode("all").alias("at", "entity")).withColumn("kind", _let(F.col("entity"), _kind))
    each = cut(each.withColumn("units", _let(F.struct("entity", "kind"), lambda x: _units(x["entity"], x["kind"]))))
    units = each.select("key", "at", "entity", F.col("kind").alias("whole"), F.posexplode("units").alias("n", "u")).select("key", "at", "entity", "whole", "n", "u.*")
    named = units.join(assign(units, key), ["kind", "form"])
    entities = named.groupBy("key", "at", "entity", "whole").agg(F.array_sort(F.collect_list(F.struct("n", "surrogate", "word"))).alias("parts"))
    new = entities.select("key", "at", _let(F.struct("entity", "whole", F.transform("parts", lambda x: x["surrogate"]).alias("parts")), lambda x: _poured(x["entity"], x["whole"], x["parts"])).alias("new"), F.filter("parts", lambda x: x["word"].isNotNull()).alias("names"))
    new = new.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "new", "names"))).alias("all"))
    names = F.flatten(F.transform("all", lambda x: x["names"]))
    first_of = lambda x, i: F.array_position(F.transform("names", lambda y: F.lower(y["word"])), F.lower(x["word"])) == i + 1
    new = new.select("key", F.transform("all", lambda x: x["new"]).alias("new"), names.alias("names")).withColumn("names", F.filter("names", first_of))
    # Copies of a text are many rows of one key: each of their groups gets its own row of what is new.
    spread = with_some.select("key", "salt").distinct().join(new, "key")
    joined = with_some.join(spread, ["key", "salt"])
    plain = lambda p: F.when(F.size("names") > 0, _mentions(p, F.col("names"), mark)).otherwise(p)
    changed = F.array_join(F.transform("pieces", lambda p, i: F.when(i % 2 == 1, F.get("new", (i / 2).cast("int"))).otherwise(plain(p))), "")
    replaced = joined.select(F.col("row").withField(f"`{text_col}`", changed).alias("row"), F.size("new").alias("n_entities"))
    return staged.where("pieces is null").select("row", F.lit(0).alias("n_entities")).unionByName(replaced).select("row.*", "n_entities")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_entities", "text")
