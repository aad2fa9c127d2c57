"""Personal data replaced by keyed surrogates, with DataFrame functions alone.

1. Detection: one pattern, applied once to each text, finds e-mail addresses (any script), phone numbers (with country code or national),
   card and account numbers, IP addresses, prefixed and hexadecimal secrets, values after a word for secrets, titled names and listed first names
   with a surname. Texts without a digit, an at sign, a title or a listed name are passed by. What was found is written beside the rows and used from there.
2. Entities: each (kind, lower-case value) of the corpus once. A name gives one for each part, whose gender is that of the title or of the
   listed first name; an e-mail address one for itself and one for its domain, so that addresses of one domain keep one domain.
3. Surrogates: a keyed SHA-512 digest of kind, value and attempt picks digits for digits and letters of the same script for letters. Top-level domains,
   country codes and the prefixes of keys stay; card and account numbers with right check digits get right ones; names are built from syllables of
   their script with an ending for their gender. An attempt fails if its surrogate is an entity of the corpus or was taken; failed ones try
   again, until none is left. So different entities stay different, equal ones equal.
4. Replacement: texts are cut at their entities and put together again with the surrogates, in the case of the original. Bare mentions of a
   document's names follow, as they were spelled, in capitals and with either apostrophe; initials move by a keyed number of letters. What has no surrogate stays: no text becomes null.

Only texts with entities are shuffled. Shuffles are keyed by entity (pre-aggregated; joins are split by adaptive execution) and by text.

Limits: people with neither a title nor a listed first name before a surname, street addresses, and secrets of other letters without a prefix or a
word for them are not found. A word that is spelled like one of the document's names is taken for it ("Mr Black likes Black tea").

Defined cases: a null text stays null, an empty one empty; a very long text is handled whole, like others; rows with a null doc_id are treated like
others; repeated rows and equal texts get equal results, a row each; where two kinds of entity fit one place the first of PATTERNS wins, and between
entities that draw one surrogate the smaller value; an empty table gives no rows; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import documents, forget, written

#: Titles with the gender they show, and common first names.
TITLES = {"m": r"Mr|Herr|Monsieur|M(?=\.)|Señor|Sr|г-н|господин", "f": "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Sra|г-жа|госпожа", "": "Mx|Dr|Prof"}
FIRST_NAMES = {
    "m": "james john robert michael david william richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward peter "
    "hans karl klaus stefan jürgen wolfgang uwe dieter heinrich otto jean pierre jacques philippe françois michel louis henri antoine jose josé juan carlos luis miguel antonio javier pedro diego "
    "giovanni marco luca paolo ivan dmitri sergei иван пётр сергей алексей дмитрий",
    "f": "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley emily donna michelle carol amanda helen anna maria laura emma julia alice "
    "petra ursula monika sabine heike katrin ingrid helga marie claire sophie isabelle nathalie camille juliette carmen lucia ana elena isabel rosa pilar teresa francesca giulia chiara olga natalia ольга анна елена мария наталья",
}
PART = r"\p{Lu}(?:\p{L}|['’-](?=\p{Lu}))+"
TITLE = "(?<!\\p{L})(?:" + "|".join(TITLES.values()) + ")(?!\\p{L})"
LISTED = r"(?<!\p{L})(?=\p{Lu})(?:" + "|".join(n.capitalize() for names in FIRST_NAMES.values() for n in names.split()) + ")(?!\\p{L})"
UNTITLED = rf"{LISTED} (?:{LISTED} )?{PART}"
#: Initials stand before a titled person's other names.
INITIAL = r"[A-Z]\."
NAME = TITLE + rf"\.? (?:{INITIAL} ){{0,3}}{PART}(?: (?:{INITIAL} )?{PART}){{0,2}}"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ADDRESS = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
#: Eight groups of hexadecimal digits, or fewer around a double colon.
GROUP = r"[0-9A-Fa-f]{1,4}"
ADDRESS_6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}}|::(?:{GROUP}:){{1,6}}{GROUP})(?![\p{{L}}\p{{N}}:])"
PHONE = "|".join(
    (
        r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
        r"(?<!\d)\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\d.,/-])0\d(?:[ .-]\d{2}){4}(?!\d)",
        r"(?<![\d.,/-])\(?0\d{2,4}\)?[ /-]\d{3,4}[ -]?\d{3,5}(?!\d)",
    )
)
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"
NUMBER = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
ACCOUNT = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])"
#: Prefixes of keys (fixed values), and what follows them.
PREFIX = r"(?:AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|[sp]k_(?:live|test)_|sk-(?:ant-|proj-)?)"
TOKEN = rf"(?<![\p{{L}}\p{{N}}]){PREFIX}[A-Za-z0-9_-]{{16,255}}(?![A-Za-z0-9_-])"
SECRET = r"(?<![\p{L}\p{N}])(?=[a-fA-F]*\d)[0-9a-fA-F]{32,}(?![\p{L}\p{N}])"
#: A value with a digit after a word for secrets and a sign that it is one; only the value is taken.
VALUE = r"(?=[A-Za-z_+/.-]{0,128}\d)[A-Za-z0-9_+/.-]{8,256}(?![A-Za-z0-9_+/.@-])"
KEYED = r"(?<=[=:\s\"'])" + VALUE.replace("[A-Za-z0-9_+/.-]{8", r"(?<=(?i:token|key|password|passwd|passphrase|pass|pwd|pin|secret|credentials?)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_+/.-]{8", 1)
#: In the order in which they are tried at a place of a text.
PATTERNS = {"email": EMAIL, "token": TOKEN, "secret": SECRET, "keyed": KEYED, "account": ACCOUNT, "phone": PHONE, "address": ADDRESS, "number": NUMBER, "card": CARD, "untitled": UNTITLED, "name": NAME, "address_6": ADDRESS_6}
ANY = "|".join(PATTERNS.values())
#: Shapes that tell a match's kind, without what stands around it; others are names.
SHAPES = {k: p for k, p in PATTERNS.items() if k not in ("keyed", "untitled", "name")} | {"keyed": VALUE}
#: Consonants and vowels of the syllables of made-up names, and endings of first names by gender and of surnames.
SCRIPTS = {
    "Latin": ("bdfgklmnprstvz", "aeiou", {"m": "n", "f": "a", "": "e", "s": "r"}),
    "Cyrillic": ("бдфгклмнпрствз", "аеиоу", {"m": "н", "f": "а", "": "е", "s": "р"}),
    "Greek": ("βγδζκλμνπρστφχ", "αεηιο", {"m": "ς", "f": "α", "": "ε", "s": "ρ"}),
}
#: First letter and number of letters that stand for a letter of a script.
ALPHABETS = {"Cyrillic": ("а", 32), "Greek": ("α", 17)}
KEY = "surrogate key of the sample queries"
#: From this attempt on, local parts, domains and names grow, so that they can't run out.
GROWS = 8
#: From this attempt on, surrogates of other kinds get a hyphen and letters behind them: their format has fewer free values than the corpus has entities of it.
RUNS_OUT = 40


def kind_of(match: Column) -> Column:
    """Kind of a match: the first shape that it is a whole instance of."""
    out = F.lit("name")
    for kind, pattern in reversed(SHAPES.items()):
        out = F.when(match.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def title_gender(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for gender in "mf":
        out = F.when(title.rlike(rf"^(?:{TITLES[gender]})\.?$"), gender).otherwise(out)
    return out


def name_parts(match: Column) -> Column:
    """The parts of a name without its title."""
    return F.slice(F.split(match, " "), F.when(match.rlike(f"^(?:{TITLE})"), 2).otherwise(1), F.lit(9))


def domain_of(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def entity(kind: Column, value: Column, gender: Column, role: Column) -> Column:
    return F.struct(kind.alias("kind"), F.lower(value).alias("value"), gender.cast("string").alias("gender"), role.cast("string").alias("role"))


def shifted_initial(initial: Column, surname: Column, key: str) -> Column:
    """Another letter for an initial: all initials of a surname move by the same keyed number of letters, so that different ones stay different."""
    move = draw(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("initial"), F.lower(surname)), 256), F.lit(0), 25) + 1
    return F.concat(letter("A", (F.ascii(initial) - ord("A") + move) % 26), F.lit("."))


def entities_of(found: Column) -> Column:
    """Entities of a match (kind, match): array of (kind, value, gender, role)."""
    kind, match, none = found["kind"], found["match"], F.lit(None)
    parts = name_parts(match)
    named = F.transform(parts, lambda part, i: entity(F.lit("name"), part, title_gender(F.split(match, " ")[0]), F.when(i == F.size(parts) - 1, "s").otherwise("g")))
    plain = entity(kind, match, none, none)
    named = F.filter(named, lambda e: ~e["value"].rlike(rf"^(?i:{INITIAL})$"))
    return F.when(kind == "name", named).when(kind == "email", F.array(plain, entity(F.lit("domain"), domain_of(match), none, none))).otherwise(F.array(plain))


def draw(digest: Column, i: Column, n: int) -> Column:
    """The i-th number below n of a digest in hexadecimal digits (two each, used in turn)."""
    return F.conv(F.substring(digest, 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int") % n


def letter(first: str, at: Column) -> Column:
    return F.char(F.lit(ord(first)) + at)


def script_letter(first: str, count: int, digest: Column, i: Column) -> Column:
    """One of `count` letters from `first` on."""
    return F.substring(F.lit("".join(chr(ord(first) + k) for k in range(count))), draw(digest, i, count) + 1, F.lit(1))


def like_for_like(digest: Column, value: Column, letters: int = 26) -> Column:
    """A digit for each digit, a letter of the same script (of Latin ones, one of the first `letters`) for each letter; other signs stay."""

    def put(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), draw(digest, i, 10).cast("string"))
        for script, (first, count) in ALPHABETS.items():
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), script_letter(first, count, digest, i))
        return out.when(c.rlike(r"\p{L}"), letter("a", draw(digest, i, letters))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), put), "")


def syllables(digest: Column, count: Column, consonants: str, vowels: str) -> Column:
    def pick(i: Column, letters: str) -> Column:
        return F.substring(F.lit(letters), draw(digest, i, len(letters)) + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(pick(2 * i, consonants), pick(2 * i + 1, vowels))), "")


def grown(digest: Column, attempt: Column) -> Column:
    """Nothing at first, more and more letters from attempt GROWS on."""
    count = F.floor(attempt / GROWS).cast("int")
    return F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: letter("a", draw(digest, i + 31, 26))), "")).otherwise("")


def made_name(digest: Column, value: Column, gender: Column, role: Column, attempt: Column) -> Column:
    """Syllables of the value's script (Latin if none fits) with the ending of its role and gender; later attempts are longer."""
    out = None
    for script, (consonants, vowels, ends) in SCRIPTS.items():
        end = F.when(role == "s", ends["s"]).when(gender == "m", ends["m"]).when(gender == "f", ends["f"]).otherwise(ends[""])
        made = F.concat(syllables(digest, F.lit(3) + F.floor(attempt / GROWS).cast("int"), consonants, vowels), end)
        out = made if out is None else F.when(value.rlike(rf"\p{{Is{script}}}"), made).otherwise(out)
    return out


def check_sum(value: Column) -> Column:
    """Of a card number: the sum of its digits, every other one from the right but the last doubled and its digits added."""
    digits = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))
    return F.aggregate(
        F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))), F.lit(0), lambda acc, d: acc + d
    )


def with_check_digit(made: Column) -> Column:
    body = F.substring(made, F.lit(1), F.length(made) - 1)
    return F.concat(body, ((10 - check_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


def remainder_97(value: Column, check: Column) -> Column:
    """Of an account number with these check digits: its rest, country and check digits, letters as 10 to 35, modulo 97."""
    plain = F.upper(F.regexp_replace(value, " ", ""))
    chars = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 2), check), "")
    return F.aggregate(chars, F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def with_account_check(made: Column) -> Column:
    check = F.lpad((98 - remainder_97(made, F.lit("00"))).cast("string"), 2, "0")
    return F.concat(F.substring(made, 1, 2), check, F.substring(made, F.lit(5), F.length(made)))


def surrogate(kind: Column, value: Column, gender: Column, role: Column, attempt: Column, key: str) -> Column:
    """Lower-case surrogate of an entity; that of an e-mail address still has its own domain."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 512)
    top, local = F.regexp_extract(value, r"\.\p{L}+$", 0), F.substring_index(value, "@", 1)
    start = F.when(kind == "phone", F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])|^\(?0", 0)).when(kind == "account", F.substring(value, 1, 2)).when(kind == "token", F.regexp_extract(value, rf"^(?i:{PREFIX})", 0)).otherwise("")
    made = F.concat(start, like_for_like(digest, F.substring(value, F.length(start) + 1, F.length(value))))
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda o, i: (F.conv(F.substring(digest, 4 * i + 1, F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string")), ".")
    own = (
        F.when(kind == "email", F.concat(like_for_like(digest, local), grown(digest, attempt), F.lit("@"), domain_of(value)))
        .when(kind == "domain", F.concat(like_for_like(digest, F.substring(value, F.lit(1), F.length(value) - F.length(top))), grown(digest, attempt), top))
        .when(kind == "address", octets)
        .when(kind.isin("secret", "address_6"), like_for_like(digest, value, 6))
        .when(kind == "name", made_name(digest, value, gender, role, attempt))
        .when((kind == "card") & (check_sum(value) % 10 == 0), with_check_digit(made))
        .when((kind == "account") & (remainder_97(value, F.substring(value, 3, 2)) == 1), with_account_check(made))
        .otherwise(made)
    )
    return F.when(~kind.isin("email", "domain", "name") & (attempt >= RUNS_OUT), F.concat(own, F.lit("-"), grown(digest, attempt - RUNS_OUT + GROWS))).otherwise(own)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for every entity (kind, value, gender, role): different ones get different surrogates, none of which is an entity."""
    known = entities.select("kind", F.col("value").alias("surrogate"))
    pending, settled = entities, None
    for attempt in itertools.count():
        tried = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("role"), F.lit(attempt), key))
        taken = known if settled is None else known.unionByName(settled.select("kind", "surrogate"))
        won = written(tried.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("value").alias("value")), "surrogates")
        settled = won if settled is None else settled.unionByName(won)
        before, pending = pending, written(pending.join(won, ["kind", "value"], "left_anti"), "pending")
        if attempt:
            forget(before)
        if pending.isEmpty():
            return settled


def in_case_of(made: Column, original: Column) -> Column:
    """made, letter by letter in the case of the original; what is longer stays small."""
    return F.array_join(F.zip_with(F.split(made, ""), F.split(original, ""), lambda m, o: F.when(o.rlike(r"\p{Lu}"), F.upper(m)).otherwise(m)), "")


def name_in_case_of(made: Column, original: Column) -> Column:
    return F.when((F.length(original) > 1) & (F.upper(original) == original), F.upper(made)).when(F.upper(F.substring(original, 1, 1)) == F.substring(original, 1, 1), F.initcap(made)).otherwise(made)


def of_map(made: Column, kind: str | Column, value: Column) -> Column:
    return made[F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), F.lower(value))]


def replaced(found: Column, made: Column, key: str) -> Column:
    """The match with its entities' surrogates, from the map made (kind:value -> surrogate). The match itself stays if it has none; it is never null."""
    kind, match = found["kind"], found["match"]
    parts = F.split(match, " ")
    name = F.concat_ws(" ", F.when(F.size(name_parts(match)) < F.size(parts), parts[0]), F.transform(name_parts(match), lambda p: F.when(p.rlike(f"^{INITIAL}$"), shifted_initial(p, F.element_at(name_parts(match), -1), key)).otherwise(F.coalesce(name_in_case_of(of_map(made, "name", p), p), p))))
    plain = of_map(made, kind, match)
    local, domain = F.substring_index(match, "@", 1), domain_of(match)
    email = F.concat(in_case_of(F.substring_index(plain, "@", 1), local), F.lit("@"), in_case_of(of_map(made, "domain", domain), domain))
    return F.coalesce(F.when(kind == "name", name).when(kind == "email", email).when(kind == "address", plain).otherwise(in_case_of(plain, match)), match)


def with_surrogates(docs: DataFrame, key: str = KEY, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with its text's personal data replaced; all columns and rows are kept. count: name of a column for the number of matches."""
    given, void = docs.columns, {c for c, kind in docs.dtypes if kind == "void"}
    own = F.col(f"`{text}`").cast("string")
    maybe = own.rlike("[0-9@]|::") | own.rlike(f"{TITLE}|{LISTED}")
    matches = F.when(maybe, F.regexp_extract_all(own, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.transform(F.coalesce(matches, F.array().cast("array<string>")), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("match")))
    # the one pass of the pattern over the corpus
    marked = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in given if c not in void]).alias("row"), found.alias("found")), "marked")
    marked = marked.withColumn("text", F.col("row").getField(text).cast("string") if text not in void else F.lit(None).cast("string"))
    # a document is known by its text: equal texts have equal entities
    some = marked.where(F.size("found") > 0).withColumn("place", F.sha2("text", 256))
    mentions = some.select("place", F.explode(F.flatten(F.transform("found", entities_of))).alias("e")).select("place", "e.*").groupBy("place", "kind", "value").agg(F.min("gender").alias("gender"), F.max("role").alias("role"))
    mentions = written(mentions, "mentions")
    listed = F.when(F.col("value").isin(FIRST_NAMES["m"].split()), "m").when(F.col("value").isin(FIRST_NAMES["f"].split()), "f")
    entities = written(mentions.groupBy("kind", "value").agg(F.min("gender").alias("gender"), F.max("role").alias("role")).withColumn("gender", F.when(F.col("kind") == "name", F.coalesce(listed, "gender"))), "entities")
    made = assigned(entities, key)
    per_text = mentions.select("place", "kind", "value").join(made, ["kind", "value"]).groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "value"), "surrogate"))).alias("made"))
    cut = F.zip_with(F.split("text", ANY, -1), F.transform("found", lambda m: replaced(m, F.col("made"), key)), lambda piece, put: F.concat(piece, F.coalesce(put, F.lit(""))))
    # the names as they are spelled, in capitals and with the other apostrophe; each form keeps the spelling whose surrogate it gets, as capitals don't always lead back to it
    spelled = F.filter(F.array_distinct(F.flatten(F.transform(F.filter("found", lambda m: m["kind"] == "name"), lambda m: name_parts(m["match"])))), lambda p: ~p.rlike(f"^{INITIAL}$"))

    def spelled_as(change) -> Column:
        return F.transform(spelled, lambda p: F.struct(change(p).alias("form"), p.alias("of")))

    forms = F.array_distinct(F.concat(spelled_as(lambda p: p), spelled_as(F.upper), *[spelled_as(lambda p, sign=sign: F.regexp_replace(p, "['’]", sign)) for sign in "'’"]))
    done = some.join(per_text, "place").select("row", "made", forms.alias("forms"), F.array_join(cut, "").alias("text"), F.size("found").alias("n_entities"))
    bare = F.aggregate("forms", F.col("text"), lambda acc, f: F.regexp_replace(acc, F.concat(F.lit(r"(?<!\p{L})\Q"), f["form"], F.lit(r"\E(?!\p{L})")), F.coalesce(name_in_case_of(of_map(F.col("made"), "name", f["of"]), f["form"]), f["form"])))
    done = done.select("row", F.when(F.size("forms") > 0, bare).otherwise(F.col("text")).alias("text"), "n_entities")
    out = done.unionByName(marked.where(F.size("found") == 0).select("row", "text", F.lit(0).alias("n_entities")))
    kept = [F.col("text").alias(c) if c == text else F.lit(None).alias(c) if c in void else F.col("row").getField(c).alias(c) for c in given]
    return out.select(*kept, *([F.col("n_entities").alias(count)] if count else []))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(documents(spark, sf_dir).select("doc_id", "text"), count="n_entities")
