"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything that touches documents is made of DataFrame functions. Texts without a candidate are left
by one pattern match; the others are split into words, and a word that holds a candidate, or a value
that the words before it name ("password: x", "password = x"), is taken with its neighbours; a block
with a private key is one candidate. The forest is trained by Spark ML on labelled findings and then written out as
a column expression (nested CASE), so that scoring needs neither a join nor a shuffle: a text's
candidates stay in its row.

Features: length, transitions between character classes, shares of digits and capitals, distinct
characters, entropy, hexadecimal form, coverage by words of a public vocabulary, path marks, a known prefix,
assignment, an address, and whether the word itself and its neighbours speak of secrets or of identifiers.

No table of labelled findings comes with the documents. ``seed_findings`` makes one by rule, with
fixed pseudo-random strings in the shapes of public key formats and of common look-alikes (commit
hashes, checksums, paths, addresses, serial numbers, names); a table of one's own with the same
columns can take its place.

Defined cases: a null or empty text has no findings; a word may hold several candidates and a
candidate may occur several times (``occurrences``); redaction replaces each accepted candidate
wherever it stands in the text, longest first; a run of any length is a candidate; values of fewer than
four characters are none. Rows repeat in the result as in the input; columns of
the documents keep their names and values, ``redacted`` only changes the text.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import written

TREES, DEPTH, SEED, EACH = 24, 6, 17, 150
THRESHOLD = 0.5
MASK = "[SECRET]"

#: A run that is long and has a digit and a letter.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}"
#: What public key formats begin with, and a value of theirs.
BEGINNINGS = "gh[opsur]_|github_pat_|glpat-|xox[abeoprs]-|sk-|sk_live_|sk_test_|rk_live_|pk_live_|npm_|pypi-|hf_|dop_v1_|shpat_"
PREFIXED = rf"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{{16}}|AIza[A-Za-z0-9_-]{{30,}}|SG\.[A-Za-z0-9_.-]{{20,}}|eyJ[A-Za-z0-9_.-]{{20,}}|(?:{BEGINNINGS})[A-Za-z0-9_-]{{16,}})"
#: The password of an address.
IN_ADDRESS = r"://[^\s:/@]+:([^\s:/@]{4,})@"
#: A block with a private key, over several lines.
KEY_BLOCK = r"(?s)-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----.*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
#: What follows the name of a secret in one word. Up to 64 characters may stand between the telling part of a name and its end.
NAMES = "pass|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private"
NAMED = rf"(?i)(?:{NAMES})[a-z_-]{{0,64}}[\"']?[:=][\"']?[^\s\"',;]{{6,}}"
CANDIDATE = rf"{PREFIXED}|{RUN}|{NAMED}"
#: The same with white space on either side of the separator: in a text, and as the ends of the words before a value.
SPACED = rf"(?i)(?:{NAMES})[a-z_-]{{0,64}}[\"']?(?:\s+[:=]+\s*|[:=]+\s+)[\"']?[^\s\"',;]{{6,}}"
NAME_END, NAME_AND_SIGN, SIGN = rf"(?i)(?:{NAMES})[a-z_-]{{0,64}}[\"']?$", rf"(?i)(?:{NAMES})[a-z_-]{{0,64}}[\"']?[:=]+$", "^[:=]+$"
ANYWHERE = rf"{CANDIDATE}|{SPACED}|{IN_ADDRESS}|-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY-----"
VALUE = r"^(?i)[a-z_-]*[\"']?[:=][\"']?(?=[^\s]{6,}$)"
TAIL = "[.:!?)\\]}>#*$%&|]+$"

# Words that names, paths and prose are made of.
DICTIONARY = (
    "access account action address admin album api app apple archive article asset author backup base beach bin blog blue book branch build cache camera card "
    "catalog center chapter class client cloud code color com commit common component config contact content controller copy count data date default demo "
    "dev device dist doc docs document download edit error etc event example export factory feed field file filter final first font format forum function "
    "gallery game green group guide handler help hidden home host http https icon image img import index info input install item java kernel lang large last "
    "lib library link list load local log login long main manager map market master media member menu message method model module month movie music name "
    "network new news node note number object office old online open option order org output package page part path pdf photo phone picture player post "
    "print private product profile program project public python query read record red release report request resource result road root sale sample "
    "script search section serial server service session setting share shop short simple site size small source spec src static store stream string "
    "style summary support system table tag target team temp template test text theme thread time tmp tool topic total travel tree type update upload "
    "url user usr util value var version video view warehouse water web week wiki window work world www year"
).split()
SECRET_WORDS = "pass|password|passwd|pwd|secret|token|apikey|api_key|api-key|key|access_key|auth|bearer|credential|credentials|login"
IDENTIFIER_WORDS = "commit|sha|sha1|sha256|md5|checksum|digest|hash|revision|rev|version|build|uuid|guid|id|isbn|serial|order|invoice|ref|tracking|etag|file|path|see|tag|branch|model|part|sku"
PREFIX = rf"^(AKIA|ASIA|AIza|SG\.|eyJ|-----BEGIN |{BEGINNINGS})"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def vocabulary(rank_path: str) -> tuple[str, ...]:
    """Words of four letters or more that a public byte-level vocabulary of many languages has whole, and DICTIONARY."""
    with open(rank_path, "rb") as f:
        found = {w[1:].decode() for a, _ in map(bytes.split, f) if re.fullmatch(rb" [a-z]{4,}", w := base64.b64decode(a))}
    return tuple(sorted(found.union(DICTIONARY)))


def listed(run: Column, words: tuple[str, ...]) -> Column:
    """Whether a run of lower-case letters is one of words, which stand in a literal by first letter."""
    by = "|".join(" ".join(["", *(w for w in words if w[0] == x), ""]) for x in LETTERS)
    return F.coalesce(F.contains(F.get(F.split(F.lit(by), r"\|"), F.ascii(run) - ord("a")), F.concat(F.lit(" "), run, F.lit(" "))), F.lit(False))


def has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def signed(before2: Column, before: Column) -> Column:
    """Whether the two words before one end in the name of a secret and a separator."""
    return has(before, NAME_AND_SIGN) | (has(before, SIGN) & has(before2, NAME_END))


def features(c: Column, word: Column, before2: Column, before: Column, after: Column, words: tuple[str, ...] = tuple(DICTIONARY)) -> dict[str, Column]:
    """By name; all numbers. c: the candidate, word: the whole word that holds it."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9"), "[^aA9]", "-")
    chars = F.split(c, "")
    letters = F.array_distinct(chars)

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(c, pattern, ""))) / n

    def entropy() -> Column:
        each = F.transform(letters, lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
        return F.aggregate(each, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "^[^a-z0-9]+|[^a-z0-9]+$", "")

    def about(words: str) -> Column:
        at = F.when(plain(before).rlike(f"^({words})$"), 3).when(plain(before2).rlike(f"^({words})$"), 2).when(plain(after).rlike(f"^({words})$"), 1)
        return F.coalesce(at, F.lit(0)).cast("double")

    prefix = F.call_function("substring_index", word, c, F.lit(1))
    out = {
        "length": n,
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1) / n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "distinct": F.size(letters) / n,
        "entropy": entropy(),
        "hexadecimal": c.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "dictionary": F.aggregate(F.regexp_extract_all(c, F.lit("([A-Z]?[a-z]+|[A-Z]+)"), F.lit(1)), F.lit(0), lambda k, x: k + F.when(listed(F.lower(x), words), F.length(x)).otherwise(0)) / n,
        "slashes": n - F.length(F.replace(c, F.lit("/"), F.lit(""))),
        "address": word.rlike(r"(?i)https?:|www\.|://|@") | word.rlike(r"^[\"'(]?[~.]{0,2}/"),
        "extension": word.rlike(r"\.[a-z]{2,4}[\"')]?[.,;:]?$"),
        "groups": word.rlike(r"^\W*[0-9A-Za-z]{2,8}(-[0-9A-Za-z]{2,12}){2,}\W*$"),
        "prefix": c.rlike(PREFIX),
        "named": F.lower(prefix).rlike(f"({NAMES})[a-z_-]*[\"']?[:=][\"']?$") | (prefix.rlike("^[\"']?$") & signed(before2, before)) | (prefix.rlike("^[:=]+[\"']?$") & has(before, NAME_END)),
        "in_address": prefix.rlike(r"://[^\s:/@]+:$"),
        "assigned": prefix.rlike("[:=][\"']?$") | has(before, SIGN) | has(before, NAME_AND_SIGN),
        "quoted": prefix.rlike("[\"'`]$"),
        "data_uri": word.rlike("(?i)base64,"),
        "secret_words": about(SECRET_WORDS),
        "identifier_words": about(IDENTIFIER_WORDS),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


def candidates_of(word: Column) -> Column:
    """Candidates in a word, as an array; what a name introduces is without the name."""
    found = F.regexp_extract_all(word, F.lit(f"({CANDIDATE})"), F.lit(1))
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, VALUE, ""), TAIL, ""))
    return F.array_union(plain, F.regexp_extract_all(word, F.lit(IN_ADDRESS), F.lit(1)))


def introduced(word: Column, before2: Column, before: Column) -> Column:
    """The value in a word that the words before it name, as an array of at most one: after a name and its separator, or with the separator in front."""
    value = F.when(signed(before2, before), F.regexp_extract(word, "^[\"']?([^\\s\"',;]{6,})", 1))
    value = value.when(has(before, NAME_END), F.regexp_extract(word, "^[:=]+[\"']?([^\\s\"',;]{6,})", 1))
    return F.filter(F.array(F.regexp_replace(F.coalesce(value, F.lit("")), TAIL, "")), lambda x: x != "")


def contexts(text: Column) -> Column:
    """Array of (candidate, word, before2, before, after) of a text."""
    words = F.split(F.trim(F.regexp_replace(text, r"[ \t\n\u000B\f\r]+", " ")), " ")

    def around(words: Column) -> Column:
        def found(i: Column) -> Column:
            return F.array_union(candidates_of(F.get(words, i)), introduced(F.get(words, i), F.get(words, i - 2), F.get(words, i - 1)))

        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).rlike(f"{CANDIDATE}|{IN_ADDRESS}") | F.get(words, i).rlike("^[:=]") | F.coalesce(F.get(words, i - 1).rlike("[:=]$"), F.lit(False)))
        each = F.transform(at, lambda i: F.transform(found(i), lambda c: F.struct(
            c.alias("candidate"), F.get(words, i).alias("word"), F.get(words, i - 2).alias("before2"), F.get(words, i - 1).alias("before"), F.get(words, i + 1).alias("after"))))
        return F.flatten(each)

    def with_blocks(blocks: Column) -> Column:
        """A key block is one candidate; its lines are none."""
        own = F.transform(blocks, lambda b: F.struct(b.alias("candidate"), b.alias("word"), F.lit("").alias("before2"), F.lit("").alias("before"), F.lit("").alias("after")))
        lines = F.get(F.transform(F.array(words), around), F.lit(0))
        return F.concat(F.filter(lines, lambda c: ~F.exists(blocks, lambda b: F.contains(b, c["candidate"]))), own)

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(KEY_BLOCK), F.lit(0))), with_blocks), F.lit(0))


def seed_findings(spark: SparkSession, each: int = EACH) -> DataFrame:
    """Labelled findings by rule: candidate, word, before2, before, after, label."""
    i, parts = F.col("id"), {}

    def kept(c: Column) -> Column:
        """c, computed once for all findings of an id."""
        parts[f"c{len(parts)}"] = c
        return F.col(f"c{len(parts) - 1}")

    def digest(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(salt), i.cast("string")), 512)

    def coded(salt: str, n: int) -> Column:
        return F.substring(F.base64(F.unhex(digest(salt))), 1, n)

    def alphanumeric(salt: str, n: int) -> Column:
        return F.substring(F.regexp_replace(F.concat(coded(salt, 80), coded(salt + "+", 80)), "[+/=]", ""), 1, n)

    def pick(salt: str, words: str) -> Column:
        return F.get(F.split(F.lit(words), " "), F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(words.split(" ")))).cast("int"))

    prose = "the of and in was on with from that than this over under der die und le la les de el los con para it be"
    p2, p1, nx = kept(pick("p2", prose)), kept(pick("p1", prose)), kept(pick("nx", prose))
    word = lambda s: pick(s, " ".join(DICTIONARY))
    number = lambda s, n: F.substring(F.regexp_replace(digest(s), "[a-f]", ""), 1, n)
    empty = F.lit("")
    name = kept(pick("name", "password passwd pwd secret token api_key apikey access_key auth_token"))
    key = kept(pick("key", "token secret password api_key key auth credential"))
    rule = kept(pick("rule", "commit sha1 sha256 md5 checksum revision rev hash digest etag"))

    def row(label: int, candidate: Column, word: Column | None = None, before2: Column = p2, before: Column = p1, after: Column = nx) -> Column:
        word = candidate if word is None else word
        return F.struct(candidate.alias("candidate"), word.alias("word"), before2.alias("before2"), before.alias("before"), after.alias("after"), F.lit(float(label)).alias("label"))

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    hex40, upper16 = kept(F.substring(digest("h"), 1, 40)), kept(F.translate(F.upper(alphanumeric("u", 16)), "0189", "ABCD"))
    mixed = kept(F.concat(F.upper(F.substring(alphanumeric("m", 8), 1, 8)), F.substring(number("m", 8), 1, 4), F.upper(F.substring(alphanumeric("n", 8), 1, 4))))
    hex18, small = kept(F.substring(digest("s"), 1, 18)), kept(alphanumeric("a", 12))
    known = kept(F.concat(pick("known", "ghp_ gho_ glpat- sk- sk_live_ xoxb- npm_ AIza"), alphanumeric("g", 36)))
    path = kept(F.concat(F.lit("/"), word("a1"), F.lit("/"), word("a2"), F.lit("/"), word("a3"), number("a4", 2), F.lit("/"), word("a5")))
    slug = kept(F.concat(word("b1"), F.lit("-"), word("b2"), F.lit("-"), word("b3"), F.lit("-"), number("b4", 4)))
    identifier = kept(F.concat(F.initcap(word("c1")), F.initcap(word("c2")), F.initcap(word("c3")), number("c4", 2)))
    snake = kept(F.concat_ws("_", word("d1"), word("d2"), word("d3"), number("d4", 3)))
    uuid = kept(F.regexp_replace(F.substring(digest("uu"), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))
    serial = kept(F.concat(F.upper(F.substring(word("e1"), 1, 3)), F.lit("-"), number("e2", 4), F.lit("-"), number("e3", 6), F.lit("-"), number("e4", 2)))
    # Values that a name and a separator introduce from the words before: short ones and letters alone are secrets, prose, places to fill in, dates and addresses are not.
    colon, sign = kept(F.concat(name, F.lit(":"))), kept(pick("sign", "= :"))
    mark = kept(pick("mark", "! @ # $ % & ? *"))
    short = kept(F.concat(F.initcap(word("p1")), number("p2", 2), mark, alphanumeric("p3", 3)))
    leet = kept(F.concat(F.initcap(F.translate(pick("l1", "monster dragon orange captain winter summer master sailor banana castle"), "aeos", "4305")), mark, alphanumeric("l2", 1), pick("l3", "horse house river cat dog")))
    tail = kept(F.concat(F.initcap(F.translate(pick("l4", "monster dragon orange captain winter summer master sailor banana castle"), "aeos", "4305")), mark, number("l5", 1)))
    letters24 = kept(F.translate(F.substring(digest("lt"), 1, 24), "0123456789", "ghjkmqtvxz"))
    block = kept(F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), coded("k1", 64), F.lit("\n"), coded("k4", 64), F.lit("\n-----END RSA PRIVATE KEY-----")))
    letters36 = kept(F.concat(pick("known2", "ghp_ ghs_ npm_ hf_"), F.translate(alphanumeric("g2", 36), "0123456789", "abcdefghij")))
    plain9 = kept(F.concat(F.lower(F.translate(alphanumeric("q1", 6), "0123456789", "abcdefghij")), number("q2", 2), F.lower(F.translate(alphanumeric("q3", 1), "0123456789", "abcdefghij"))))
    common = kept(F.concat(pick("q4", "hunter monster dragon orange captain winter summer master sailor banana castle"), number("q5", 2), F.lower(F.translate(alphanumeric("q6", 1), "0123456789", "abcdefghij"))))
    prose1 = kept(pick("t1", "mandatory optional protected incorrect invalid missing changed unknown disabled Johnson Anderson Petersen Contact Reporter Submitted Management available everything Anmeldung Kennwort obligatoire utilisateur necesaria contrasena"))
    fill_in = kept(pick("t2", "your_password <your-token> ${SECRET_KEY} ******** {{password}} <password> YOUR_API_KEY xxxxxxxx $PASSWORD process.env.TOKEN"))
    day = kept(F.concat(F.lit("20"), number("t3", 2), F.lit("-0"), number("t4", 1), F.lit("-1"), number("t5", 1)))
    mail = kept(F.concat(word("t6"), F.lit("."), word("t7"), F.lit("@"), word("t8"), F.lit(".org")))
    names = kept(pick("who", "author authors authority password token secret passenger passage auth private"))
    sets = [
        row(1, hex40, quoted(hex40), key, F.lit("=")), row(1, hex40, quoted(hex40), key, F.lit(":")), row(1, hex18, F.concat(name, F.lit("="), hex18)),
        row(1, alphanumeric("b", 20), F.concat(name, F.lit("="), alphanumeric("b", 20))), row(1, small, F.concat(name, F.lit(":"), small)), row(1, coded("w", 40), coded("w", 40), key, F.lit("=")),
        row(1, F.concat(F.lit("AKIA"), upper16)), row(1, F.concat(F.lit("AKIA"), mixed)), row(1, F.concat(F.lit("AKIA"), upper16), quoted(F.concat(F.lit("AKIA"), upper16)), key, F.lit("=")),
        row(1, known), row(1, known, quoted(known), key, F.lit("=")), row(1, F.concat(F.lit("eyJ"), alphanumeric("j", 40)), before=F.lit("Bearer")), row(1, coded("x", 40), quoted(coded("x", 40)), key, F.lit(":")),
        row(0, hex40, before=rule), row(0, F.substring(digest("k"), 1, 32), before=rule), row(0, F.substring(digest("k2"), 1, 64), before2=rule, before=F.lit(":")), row(0, hex40, F.concat(hex40, F.lit(".")), rule, pick("w", "is of for was")),
        row(0, hex40), row(0, F.substring(digest("k3"), 1, 32)), row(0, uuid, before=pick("q", "id uuid guid")), row(0, uuid), row(0, path), row(0, path, F.concat(path, F.lit(".py")), before=F.lit("file")),
        row(0, path, F.concat(F.lit("https://"), word("h1"), F.lit(".org"), path)), row(0, slug, F.concat(F.lit("https://www."), word("h2"), F.lit(".com/"), slug)), row(0, slug), row(0, identifier), row(0, snake),
        row(0, snake, F.concat(snake, F.lit("="), number("v", 3))), row(0, serial, before=pick("r", "order serial sku ref invoice model part")), row(0, serial), row(0, coded("im", 60), F.concat(F.lit("data:image/png;base64,"), coded("im", 60))),
        row(0, F.concat(word("f1"), number("f2", 8), word("f3")), before=F.lit("see")), row(0, slug, F.concat(name, F.lit("="), slug), empty, empty), row(0, identifier, F.concat(name, F.lit("="), identifier)),
        *(row(1, c, before=colon) for c in (short, leet, tail, small, hex18, letters24)), *(row(1, c, quoted(c), name, sign) for c in (short, leet, tail)), row(1, letters24, before2=name, before=sign),
        row(1, short, F.concat(F.lit("="), short), before=name), row(1, tail, F.concat(name, sign, tail)),
        *(row(0, c, before=F.concat(names, F.lit(":"))) for c in (prose1, F.initcap(prose1), day, mail, identifier)), row(0, prose1, before2=names, before=sign), row(0, word("t9"), before=F.concat(names, F.lit(":"))),
        row(1, leet, F.concat(F.lit("postgres://"), word("u1"), F.lit(":"), leet, F.lit("@"), word("u2"), F.lit(".org/"), word("u3"))), row(1, small, F.concat(F.lit("https://"), word("u4"), F.lit(":"), small, F.lit("@"), word("u5"), F.lit(".com"))),
        row(1, block, block, empty, empty, empty), row(1, letters36, letters36), row(1, letters36, letters36, key, F.lit("=")), row(1, plain9, before=colon), row(1, plain9, quoted(plain9), name, sign), row(1, plain9, F.concat(name, F.lit("="), plain9)),
        row(1, common, before=colon), row(1, common, before2=name, before=sign), row(1, common, F.concat(name, F.lit("="), common)),
        row(0, fill_in, before=colon), row(0, fill_in, before2=name, before=sign), row(0, prose1, F.concat(names, sign, prose1)),
    ]
    every = spark.range(0, each, 1, 1)
    for name, c in parts.items():  # one after another, as some are made of others
        every = every.withColumn(name, c)
    return every.select(F.explode(F.array(*sets)).alias("x")).select("x.*")


def tree_sql(lines: list[str]) -> str:
    """A tree of Spark ML's debug string as nested CASE; {0}, {1}, ... stand for the features."""

    def node(at: int) -> tuple[str, int]:
        if m := re.match(r"\s*Predict: ([-\d.E]+)", lines[at]):
            return m[1], at + 1
        m = re.match(r"\s*If \(feature (\d+) <= ([-\d.E]+)\)", lines[at])
        yes, at = node(at + 1)
        no, at = node(at + 1)
        return f"CASE WHEN {{{m[1]}}} <= {m[2]}D THEN {yes} ELSE {no} END", at

    return node(0)[0]


class Forest:
    """Share of the trees that call a finding a secret, as a column."""

    def __init__(self, trees: list[str], names: list[str], words: tuple[str, ...] = tuple(DICTIONARY)):
        self.trees, self.names, self.words = trees, names, words

    def score(self, values: Column) -> Column:
        """values: an array of the features, in the order of names."""

        def column(sql: str) -> Column:
            stack, pos = [], 0
            parts = re.findall(r"CASE WHEN|\{\d+\}|<=|THEN|ELSE|END|-?[\d.]+(?:E-?\d+)?D?", sql)

            def read(pos: int) -> tuple[Column, int]:
                if parts[pos] != "CASE WHEN":
                    return F.lit(float(parts[pos].rstrip("D"))), pos + 1
                feature, limit = int(parts[pos + 1][1:-1]), float(parts[pos + 3].rstrip("D"))
                yes, pos = read(pos + 5)
                no, pos = read(pos + 1)
                return F.when(F.get(values, F.lit(feature)) <= limit, yes).otherwise(no), pos + 1

            return read(pos)[0]

        total = column(self.trees[0])
        for t in self.trees[1:]:
            total = total + column(t)
        return total / len(self.trees)


def trained(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, words: tuple[str, ...] = tuple(DICTIONARY)) -> Forest:
    """By Spark ML, on all rows of findings, a small table. words: the dictionary whose coverage of a candidate counts."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    own = features(F.col("candidate"), F.col("word"), F.col("before2"), F.col("before"), F.col("after"), words)
    table = written(written(findings.coalesce(1), "findings").select(*(v.alias(k) for k, v in own.items()), "label"), "features")
    rows = VectorAssembler(inputCols=list(own), outputCol="features").transform(table).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64).fit(rows)
    text = model.toDebugString.split("\n")
    starts = [i for i, x in enumerate(text) if re.match(r"\s*Tree \d+", x)]
    return Forest([tree_sql([x for x in text[a + 1 : b] if x.strip()]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)], list(own), words)


def judged(text: Column, forest: Forest, threshold: float = THRESHOLD) -> Column:
    """Accepted candidates of a text: array of (candidate, score); null where the text has no candidate."""

    def one(c: Column) -> Column:
        own = features(c["candidate"], c["word"], c["before2"], c["before"], c["after"], forest.words)
        score = F.get(F.transform(F.array(F.array(*own.values())), forest.score), F.lit(0))
        return F.struct(c["candidate"].alias("candidate"), score.alias("score"))

    scored = F.filter(F.transform(F.filter(contexts(text), lambda c: F.length(c["candidate"]) >= 4), one), lambda x: x["score"] >= threshold)
    return F.when(text.rlike(ANYWHERE), scored)


def findings(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, candidate, start (0-based, of the first occurrence), occurrences, score: a row for each accepted candidate of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike(ANYWHERE))
    each = rows.select("id", "t", F.explode(judged(F.col("t"), forest, threshold)).alias("f"))
    each = each.select("id", F.col("f.candidate").alias("candidate"), (F.instr("t", F.col("f.candidate")) - 1).cast("long").alias("start"), ((F.length("t") - F.length(F.replace("t", F.col("f.candidate"), F.lit("")))) / F.length("f.candidate")).cast("long").alias("occurrences"), F.col("f.score").alias("score"))
    return each.groupBy("id", "candidate", "start", "occurrences").agg(F.max("score").alias("score")).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with accepted candidates masked."""
    text = F.col(text_col).cast("string")
    found = F.reverse(F.array_sort(F.transform(F.array_distinct(F.transform(judged(text, forest, threshold), lambda f: f["candidate"])), lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))))
    return docs.withColumn(text_col, F.coalesce(F.aggregate(found, text, lambda t, f: F.replace(t, f["c"], F.lit(MASK))), text))
