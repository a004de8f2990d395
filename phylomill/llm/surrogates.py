"""Operator 5: personal data replaced by keyed surrogates, in DataFrame operations only.

Mentions of e-mail addresses, IP addresses, bank account, card, telephone and social security numbers, secrets and
titled names are found by one pattern. A mention's canonical form (digits only, lower case, single blanks) is its entity; equal
entities get equal surrogates everywhere, whatever their format. A surrogate comes from SHA-256 of key, kind, entity
and attempt. It keeps the kind's form: digits for digits, letters of the same script and case for letters,
separators as they are; card numbers keep their Luhn remainder, account numbers get check digits, addresses their top-level domain, names their title,
number of parts, script and the gender that the title tells.

The parts of names are keyed each by itself, whatever the title and the other parts: a part has one stem everywhere.
The first of several parts ends by gender; a last or only part, a surname, is the same under all titles. Stems are
distinct and get a syllable more with each attempt, so any number of names has distinct surrogates. Where a text names
somebody with a title, the same name's parts are replaced in the rest of the text as well, with or without a title, so
that all mentions still tell of one person; but for parts that the corpus has as ordinary words in lower case (Will, May),
which are replaced behind a title only. Hyphens and apostrophes of a part stay.

Surrogates are made for the distinct entities and checked: one that two entities of a kind share, or that is an
entity of the corpus itself, is made anew with the next attempt for all but the least entity, until none is left.
Late attempts make surrogates longer, so that the checks end however many entities a form has.
Only rows with a mention are joined with the surrogates; all others pass by.

Defined cases: a null text stays null; an empty text and one without mentions are unchanged; repeated rows get equal
texts; an own column n_mentions is replaced; lengths of names and IP addresses may change, and so may those of
mentions whose form has too few distinct surrogates; all others keep their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomill.llm.repeats import quoted, unused
from phylomill.stash import stash

LEAST_PLAIN = 2  # documents that have an ordinary word in lower case, at least
MOST_PARTS = 500_000  # parts of names that are sent to all executors (under 30 MB), and joined beyond
LATE = 16  # attempts from which on surrogates grow
# Titles and the gender they tell.
FEMALE = "Mrs Ms Miss Frau Mme Madame Mlle Sra Señora Srta Doña Госпожа Κυρία".split()
MALE = "Mr Sir Herr Monsieur Sr Señor Don Господин Κύριος".split()
NEUTRAL = "Dr Prof Professor President Mx".split()
# Alphabets and name syllables by script.
ALPHABETS = {"[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[0-9]": "0123456789", "[à-öø-ÿ]": "àâäçèéêëíïñóôöúüÿ", "[À-ÖØ-Þ]": "ÀÂÄÇÈÉÊËÍÏÑÓÔÖÚÜÞ", "[а-я]": "абвгдежзиклмнопрстуфхцчшэюя", "[А-Я]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
HEX = {"[0-9]": "0123456789", "[a-f]": "abcdef", "[A-F]": "ABCDEF"}
SYLLABLES = {
    r"\p{IsCyrillic}": ("ба ве ги до жу за ки ле ми но па ре си ту фа хо".split(), ("а", "ин", "о")),
    r"\p{IsGreek}": ("βα γε δι ζο θυ κα λε μι νο πα ρε σι του φα χο ψι".split(), ("α", "ος", "ι")),
    "": ("ba ce di fo gu ha je ki lo mu na pe ri so tu va".split(), ("a", "an", "e")),
}
TITLES = "|".join(FEMALE + MALE + NEUTRAL)
PART = r"(?=\p{Lu}[\p{L}'-])\p{Lu}\p{L}*(?:['-]\p{L}{2,})*"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.? {PART}(?: {PART}){{0,2}}"
EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){BYTE}(?:\.{BYTE}){{3}}(?!\.?[0-9])"
GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![0-9A-Za-z:])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}})(?![0-9A-Za-z:])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"
PHONE = r"(?<![\p{L}0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![\p{L}0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
# a look behind for a keyword is dear, so it comes after cheap tests of what is around a place
_AFTER = r"(?<=[:=\s\"'])"
_KEYWORD = r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"
# Beginnings that tell a secret by themselves, and are kept.
PREFIXES = ("AKIA", "ASIA", "sk-", "ghp_", "xoxb-", "eyJ")
SECRET = (
    rf"(?=[AEaegksx])(?<![\p{{L}}0-9_-])(?:A[KS]IA[0-9A-Z]{{16}}|(?:sk-|ghp_|xoxb-)[A-Za-z0-9_-]{{20,200}}|eyJ[A-Za-z0-9_-]{{8,}}(?:\.[A-Za-z0-9_-]{{8,}}){{1,2}})(?![\p{{L}}0-9_-])|"
    r"(?=[0-9a-fA-F]{32})(?<![\p{L}0-9])[0-9a-fA-F]{32,128}(?![\p{L}0-9])"
    rf"|{_AFTER}(?:(?=[A-Za-z0-9+/_-]{{16}})(?<=(?i:key|token|secret|password|passwd){_KEYWORD}[A-Za-z0-9+/_-]{{16,}}"
    rf"|(?=[!#-&(-~]{{8}})(?=[!-~]{{0,63}}[0-9])(?<=(?i:password|passwd){_KEYWORD}[!#-&(-~]{{8,64}})"
)
# one look ahead passes most places by all patterns of a sort
PATTERN = rf"{EMAIL}|{SECRET}|(?=[0-9A-Fa-f]{{1,4}}:){IPV6}|(?=[+(0-9])(?:{IP}|{SSN}|{CARD}|{PHONE})|(?=\p{{Lu}})(?:{IBAN}|{NAME})"
#: No mention is without a digit, an @, two colons, one of these or a keyword of a secret.
HINTS = [*FEMALE, *MALE, *NEUTRAL]


def _hinted(text: Column) -> Column:
    """Whether a text may have a mention: plain searches, many times as fast as the pattern."""
    out = text.rlike("[0-9@]|::") | text.rlike("(?i)key|token|secret|passw|sk-|ghp_|xoxb-|eyJ")
    for word in HINTS:
        out = out | text.contains(word)
    return out


def _kind(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    secret = r"[0-9a-fA-F]{32,128}"
    return F.when(m.contains("@"), "email").when(whole(secret), "secret").when(whole(IP), "ip").when(whole(IPV6), "ipv6").when(whole(IBAN), "iban").when(whole(SSN), "ssn").when(whole(CARD), "card").when(whole(PHONE), "phone").when(whole(NAME), "name").otherwise("secret")


def _entity(kind: Column, m: Column) -> Column:
    return F.when(kind.isin("email", "ipv6"), F.lower(m)).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(kind.isin("card", "ssn", "phone"), F.regexp_replace(m, "[^0-9+]", "")).when(kind == "name", F.lower(F.regexp_replace(m, r"\. ", " "))).otherwise(m)


def _hex(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _number(h: Column, i: Column | int) -> Column:
    """The i-th 16-bit number of a hash."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(h, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _spelled(text: Column, h: Column, alphabets: dict[str, str]) -> Column:
    """``text`` with each letter and digit replaced by one of its alphabet."""

    def one(c: Column, i: Column) -> Column:
        n = _number(_hex(h, (i / 16).cast("int").cast("string")), i)
        out = c
        for pattern, letters in reversed(alphabets.items()):
            out = F.when(c.rlike(pattern), F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    back = F.split(F.reverse(digits), "")
    each = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10


def _check_digits(country: Column, account: Column) -> Column:
    """Two digits that make an account number's remainder by 97 one."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    signs = F.split(F.concat(account, country, F.lit("00")), "")
    left = F.aggregate(signs, F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.lpad((98 - left).cast("string"), 2, "0")


def _by_script(part: Column, made) -> Column:
    """``made(syllables, endings)`` of the script of a name's part."""
    out = None
    for script, forms in reversed(SYLLABLES.items()):
        out = made(*forms) if out is None else F.when(part.rlike(script), made(*forms)).otherwise(out)
    return out


def _syllable(syllables: list[str], h: Column, i: Column | int) -> Column:
    return F.element_at(F.array(*map(F.lit, syllables)), _number(h, i) % len(syllables) + 1)


def _stem(part: Column, h: Column, attempt: Column) -> Column:
    """Syllables for a part of a name, one more with each attempt."""
    long = lambda i: _hex(h, (i / 16).cast("int").cast("string"))
    return _by_script(part, lambda syllables, _: F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: _syllable(syllables, long(i), i)), ""))


def _named(title: Column, part: Column, stem: Column, first: Column, key: str) -> Column:
    """A part's surrogate: the first of several parts ends by the gender of the title, all others by a syllable of their own."""
    gender = F.when(title.isin([t.lower() for t in FEMALE]), 0).when(title.isin([t.lower() for t in MALE]), 1).otherwise(2)
    h = _hex(F.lit(key), F.lit("ending"), part)
    return F.concat(stem, _by_script(part, lambda syllables, ends: F.when(first, F.element_at(F.array(*map(F.lit, ends)), gender + 1)).otherwise(_syllable(syllables, h, 0))))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity, in canonical form; of a name's part, its stem."""
    h = _hex(F.lit(key), kind, entity, attempt.cast("string"))
    local, domain = F.split(entity, "@", 2)[0], F.split(entity, "@", 2)[1]
    host, top = F.regexp_replace(domain, r"\.[^.]+$", ""), F.regexp_extract(domain, r"\.[^.]+$", 0)
    # short forms run out of surrogates of their length; late attempts make them longer
    late = attempt >= LATE
    longer = F.when(late, F.substring(h, F.lit(1), attempt - LATE + 1)).otherwise("")
    digits = F.translate(longer, "abcdef", "012345")
    email = F.concat(_spelled(local, h, ALPHABETS), longer, F.lit("@"), _spelled(host, _hex(F.lit(key), F.lit("host"), host), ALPHABETS), top)
    ip = F.concat_ws(".", *[(_number(h, i) % 254 + 1).cast("string") for i in range(4)])  # a form with 4e9 surrogates
    hexed = F.concat(_spelled(entity, h, HEX), longer)
    made = F.concat(_spelled(entity, h, ALPHABETS), digits)
    body = F.substring(made, F.lit(1), F.length(made) - 1)
    card = F.concat(body, ((_luhn(entity) - _luhn(F.concat(body, F.lit("0"))) + 10) % 10).cast("string"))
    prefix = F.regexp_extract(entity, r"^\+[0-9]", 0)
    phone = F.concat(prefix, F.substring(made, F.length(prefix) + 1, F.length(made)))
    country, account = F.substring(entity, 1, 2), F.substring(made, F.lit(5), F.length(made))
    iban = F.concat(country, _check_digits(country, account), account)
    known = F.length(F.regexp_extract(entity, rf"^(?:{'|'.join(PREFIXES)})", 0))
    secret = F.when(entity.rlike("^[0-9a-fA-F]+$"), hexed).otherwise(F.concat(F.substring(entity, F.lit(1), known), F.substring(made, known + 1, F.length(made))))
    by_kind = {"email": email, "ip": ip, "ipv6": hexed, "iban": iban, "card": card, "phone": phone, "part": _stem(entity, h, attempt), "secret": secret}
    out = made
    for name, value in by_kind.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _filled(mention: Column, made: Column) -> Column:
    """``made``'s letters and digits put into ``mention``'s places, in ``mention``'s case."""
    sign = r"[\p{L}\p{N}]"
    letters = F.split(F.regexp_replace(made, r"[^\p{L}\p{N}]", ""), "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s: Column, c: Column) -> Column:
        new = F.get(letters, s["k"])
        new = F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
        hit = c.rlike(sign)
        return F.struct(F.concat(s["out"], F.when(hit, F.coalesce(new, c)).otherwise(c)).alias("out"), (s["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(F.split(mention, ""), start, step, lambda s: s["out"])


def _given(mention: Column) -> Column:
    """The parts of a titled name as they stand."""
    return F.slice(F.split(F.regexp_replace(mention, r"\. ", " "), " "), 2, 8)


def _new_parts(mention: Column, made: Column) -> Column:
    """Their surrogates, in the case of what they replace."""
    capital = lambda m: F.concat(F.upper(F.substring(m, 1, 1)), F.substring(m, F.lit(2), F.length(m)))
    rest = lambda m, k: F.substring(m, k + 1, F.length(m))

    def one(g: Column, m: Column) -> Column:
        sign = F.regexp_extract(g, "['-]", 0)
        k = F.greatest(F.lit(1), F.least(F.instr(g, sign) - 1, F.length(m) - 2))  # where it stands, with a letter or more around it
        m = F.when(sign == "", capital(m)).otherwise(F.concat(capital(F.substring(m, F.lit(1), k)), sign, capital(rest(m, k))))
        return F.when((F.length(g) > 1) & (g == F.upper(g)), F.upper(m)).otherwise(m)

    return F.zip_with(_given(mention), F.slice(F.split(made, " "), 2, 8), one)


def rendered(kind: Column, mention: Column, made: Column) -> Column:
    """A surrogate in the format of the mention that it replaces."""
    title = F.regexp_extract(mention, r"^\S+ ", 0)
    name = F.concat(title, F.array_join(_new_parts(mention, made), " "))
    return F.when(kind == "name", name).when((kind == "ip") | (F.length(made) > F.length(mention)), made).otherwise(_filled(mention, made))


def _again(gap: Column, parts: Column) -> Column:
    """A piece of text between mentions, with parts of names that the text has with a title replaced."""
    whole = lambda p: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), p["old"], F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.aggregate(parts, gap, lambda t, p: F.when(t.contains(p["old"]), F.regexp_replace(t, whole(p), p["new"])).otherwise(t))


def keyed(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity), no two of a kind with one surrogate."""
    names = entities.where("kind = 'name'").withColumn("words", F.split("entity", " "))
    names = names.select("entity", F.col("words")[0].alias("title"), F.size("words").alias("n"), F.posexplode(F.slice("words", 2, 8)).alias("at", "part"))
    parts = names.select(F.lit("part").alias("kind"), F.col("part").alias("entity")).distinct()
    made = stash(_distinct(entities.where("kind != 'name'").select("kind", "entity").unionByName(parts), key), "distinct")
    names = names.join(made.where("kind = 'part'").select(F.col("entity").alias("part"), F.col("surrogate").alias("stem")), "part")
    names = names.withColumn("new", _named(F.col("title"), F.col("part"), F.col("stem"), (F.col("at") == 0) & (F.col("n") > 2), key))
    names = names.groupBy("entity", "title").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new"))
    names = names.select(F.lit("name").alias("kind"), "entity", F.concat_ws(" ", "title", "new").alias("surrogate"))
    return made.where("kind != 'part'").unionByName(names)


def _distinct(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate): surrogates, of the parts of names stems, that are distinct and not in the corpus."""
    # spread out by a number: few bytes, but a surrogate takes long to make
    entities = stash(entities.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "entity"), "entities")
    made = stash(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.lit(0), key)), "surrogates")
    # a stem gets an ending of one or two letters, which mustn't make it a part of the corpus
    own = F.when(F.col("kind") == "part", F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.substring("entity", F.lit(1), F.length("entity") - k))).otherwise(F.array("entity"))
    taken = entities.select("kind", F.explode(own).alias("surrogate")).distinct().withColumn("taken", F.lit(True))
    while True:
        shared = made.groupBy("kind", "surrogate").agg(F.count("*").alias("c"), F.min("entity").alias("least")).where("c > 1")
        marked = made.join(shared, ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left")
        again = (F.col("least").isNotNull() & (F.col("entity") != F.col("least"))) | F.col("taken").isNotNull()
        marked = stash(marked.select("kind", "entity", "attempt", "surrogate", again.alias("again")), "checked")
        if marked.where("again").isEmpty():
            return made.select("kind", "entity", "surrogate")
        attempt = F.col("attempt") + F.col("again").cast("int")
        anew = F.when(F.col("again"), surrogate(F.col("kind"), F.col("entity"), attempt, key)).otherwise(F.col("surrogate"))
        made = stash(marked.select("kind", "entity", attempt.alias("attempt"), anew.alias("surrogate")), "surrogates")


def mentions(docs: DataFrame) -> DataFrame:
    """(k1, k2, at, kind, mention, entity): all mentions of each distinct text that has some."""
    found = docs.where(_hinted(F.col("text"))).select("text", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found")).where(F.size("found") > 0)
    rows = found.select(*_text_key(), F.posexplode("found").alias("at", "mention")).dropDuplicates(["k1", "k2", "at"])
    rows = rows.withColumn("kind", _kind(F.col("mention")))
    return rows.withColumn("entity", _entity(F.col("kind"), F.col("mention")))


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.length("text"), F.crc32(F.col("text").cast("binary")), F.lit(1)).alias("k2")]


def ordinary(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, plain): for each distinct titled name (entity, times), those of its parts that are words of the language as
    well: ``LEAST_PLAIN`` documents or more, and as many as it has mentions with a title, have them in lower case."""
    parts = names.select("entity", "times", F.explode(F.slice(F.split("entity", " "), 2, 8)).alias("part"))
    titled = stash(parts.groupBy("part").agg(F.sum("times").alias("titled")), "parts")
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}'-])\p{Ll}{2,24}(?![\p{L}'-])"), F.lit(0)))).alias("part"))
    each = each.join(F.broadcast(titled) if titled.count() <= MOST_PARTS else titled, "part").groupBy("part").agg(F.count("*").alias("n"), F.first("titled").alias("titled"))
    plain = each.where((F.col("n") >= LEAST_PLAIN) & (F.col("n") >= F.col("titled"))).select("part")
    return parts.join(plain, "part").groupBy("entity").agg(F.collect_set("part").alias("plain"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in each text, and n_mentions (long). Who has ``key`` can make the surrogates again."""
    if not key:
        raise ValueError("a key is needed")
    docs = docs.drop("n_mentions")
    found = stash(mentions(docs), "mentions")
    named = stash(found.where("kind = 'name'").groupBy("entity").agg(F.count("*").alias("times")), "names")
    table = stash(keyed(found.select("kind", "entity").distinct(), key).join(ordinary(docs, named), "entity", "left"), "table")
    ready = found.join(table, ["kind", "entity"])
    # a part that is an ordinary word as well is replaced behind a title only
    both = F.arrays_zip(_given(F.col("mention")).alias("old"), _new_parts(F.col("mention"), F.col("surrogate")).alias("new"))
    both = F.filter(both, lambda p: ~F.coalesce(F.array_contains("plain", F.lower(p["old"])), F.lit(False)))
    pairs = F.when(F.col("kind") == "name", both).otherwise(F.array().cast("array<struct<old:string,new:string>>"))
    ready = ready.select("k1", "k2", "at", rendered(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"), pairs.alias("pairs"))
    names = [unused(docs, x) for x in ("new_", "parts_", "k1_", "k2_")]
    new, parts, k1, k2 = names
    # of a part with two surrogates (first and last in different names) the least one
    once = F.array_sort(F.array_distinct(F.flatten(F.collect_list("pairs"))))
    by_text = ready.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias(new), once.alias(parts))
    has = F.coalesce(_hinted(F.col("text")) & F.col("text").rlike(PATTERN), F.lit(False))
    plain = docs.where(~has).withColumn("n_mentions", F.lit(0).cast("long"))
    rich = docs.where(has)
    rich = rich.withColumns(dict(zip((k1, k2), _text_key()))).join(by_text, [k1, k2])
    gaps = F.transform(F.split("text", PATTERN, -1), lambda g: _again(g, F.col(parts)))
    text = F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    rich = rich.withColumn("n_mentions", F.size(new).cast("long")).withColumn("text", text)
    return plain.unionByName(rich.select(*quoted(plain.columns)))


def op5_surrogates(spark, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.phylomill.surrogates.key", "a key for test tables")
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)
