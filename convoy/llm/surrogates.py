"""Surrogates for personal data: keyed stand-ins of the same type, gender, script and format.

Mentions are reduced to entities (a phone number is its digits, however it is written; a person is a
given name and a surname, and either alone where the person recurs), so all mentions of one entity get one stand-in. Stand-ins come from a keyed hash
of the entity. Over the whole corpus no two entities of a type may share one, and none may be a real
entity: the entities that lose such a clash draw again, round by round. Only distinct entities take
part in that, and only texts with mentions are shuffled to meet their stand-ins.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convoy.llm.common import stage, text_key

#: Rounds without a new stand-in after which a type's space is taken to be exhausted.
STALLED = 100
#: From this attempt on, stand-ins of names and addresses grow, so that their space does.
GROW = 4

# Titles that announce a name, by the gender they tell.
TITLES = {
    "M": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "Κύριος"),
    "F": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа", "Κυρία"),
    "U": ("Dr", "Prof"),
}
# Given names that tell a person without a title.
KNOWN = {
    "M": ("James", "John", "Robert", "Michael", "David", "Thomas", "Peter", "Paul", "Hans", "Klaus", "Jean", "Pierre", "Luis", "Carlos", "José",
          "William", "Richard", "Joseph", "Daniel", "Matthew", "Andrew", "Wolfgang", "Jürgen", "Stefan", "François", "Antonio", "Giovanni", "Raj", "Mohammed", "Ahmed"),
    "F": ("Mary", "Anna", "Linda", "Susan", "Sarah", "Laura", "Emma", "Julia", "Greta", "Ursula", "Marie", "Claire", "Carmen", "Lucía", "Elena",
          "Patricia", "Jennifer", "Elizabeth", "Barbara", "Jessica", "Karen", "Sabine", "Monika", "Ingrid", "Isabelle", "Giulia", "Francesca", "Priya", "Fatima", "Aisha"),
    "M-CYRILLIC": ("Иван", "Пётр", "Олег", "Борис"),
    "F-CYRILLIC": ("Анна", "Ольга", "Вера", "Нина"),
    "M-GREEK": ("Γιώργος", "Νίκος", "Κώστας", "Δημήτρης"),
    "F-GREEK": ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία"),
}
# Given names that stand in for others first. None of them is known above, so few are real entities.
GIVEN = {
    "M": ("Edward", "Henry", "Walter", "Arthur", "Martin", "Oscar", "Hugo", "Victor", "Julian", "Simon", "Marco", "Lorenzo", "Felix", "Adrian", "Bruno"),
    "F": ("Helen", "Alice", "Clara", "Nora", "Sophie", "Amelia", "Diana", "Louise", "Paula", "Teresa", "Irene", "Sylvia", "Martina", "Beatrice", "Adele"),
    "U": ("Robin", "Sasha", "Jamie", "Casey", "Morgan", "Riley", "Taylor", "Quinn"),
}
GIVEN_CYRILLIC = {"M": ("Павел", "Андрей", "Глеб", "Игорь"), "F": ("Мария", "Ирина", "Тамара", "Полина"), "U": ("Саша", "Женя", "Валя")}
GIVEN_GREEK = {"M": ("Πέτρος", "Ανδρέας", "Σταύρος", "Λουκάς"), "F": ("Ειρήνη", "Δήμητρα", "Βασιλική", "Άννα"), "U": ("Χάρης", "Μάριον")}
# Letters of made-up names (consonants, vowels), and how made-up given names end by gender.
SYLLABLES = {"latin": ("bcdfghklmnprstvw", "aeiou"), "cyrillic": ("бвгдклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστφ", "αειου")}
ENDINGS = {
    "latin": {"M": ("bert", "mund", "rick", "son"), "F": ("ina", "ella", "ette", "ia"), "U": ("y", "in")},
    "cyrillic": {"M": ("слав", "мир", "рий"), "F": ("ина", "лия", "ана"), "U": ("ша", "ня")},
    "greek": {"M": ("νος", "τος", "ρας"), "F": ("ίνα", "ούλα", "ία"), "U": ("ις", "ιν")},
}
# Calling codes of one and of two digits; all others have three.
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54",
           "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
# How keys of widespread services begin.
KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza")

_GENDER = {n.lower(): g[0] for names in (TITLES, KNOWN) for g, ns in names.items() for n in ns}
_TITLE = "|".join(re.escape(t) for ts in TITLES.values() for t in ts)
_KNOWN = "|".join(n for ns in KNOWN.values() for n in ns)
# a possessive s is no part of a name
_WORD = r"[^\W\d_]+(?:['’-](?![sS]\b)[^\W\d_]+)?"
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NUMBERS = re.compile(
    rf"(?P<IP>(?<![\d.]){_BYTE}(?:\.{_BYTE}){{3}}(?![\d]|\.\d))"
    r"|(?P<IBAN>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<TOKEN>(?<![0-9A-Za-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{24,}(?![0-9A-Za-z]))"
    r"|(?P<CARD>(?<![\d+])(?:\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
    r"|(?P<SSN>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<PHONE>(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.+])\d{3}(?P<q>[ .-])\d{3}(?P=q)\d{4}(?!\d))"
)
NAMES = re.compile(
    rf"(?<!\w)(?:(?P<title>{_TITLE})\.? (?P<a>{_WORD})(?: (?P<b>{_WORD}))?|(?P<given>{_KNOWN}) (?P<surname>{_WORD}))(?!\w)"
)
#: Words without which NAMES finds nothing.
_WORDS = re.compile(r"\w+").findall
_TRIGGERS = frozenset(w for names in (TITLES, KNOWN) for ns in names.values() for n in ns for w in _WORDS(n)[:1])
SECRETS = re.compile(rf"(?<![0-9A-Za-z])(?P<lead>{'|'.join(map(re.escape, KEYS))})[0-9A-Za-z_-]{{10,}}")
#: Two colons with hexadecimal digits between: without them, no IPv6 address.
_COLONS = re.compile(":[0-9A-Fa-f]{0,4}:").search
IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)")
LOCAL = re.compile(r"[\w.+%-]").match
DOMAIN = re.compile(r"[\w-]{1,63}(?:\.[\w-]{1,63})+")


def _iban_ok(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def luhn_ok(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _ip6(mention: str) -> str | None:
    """The normal form of an address; too short ones are no addresses but times or names of code."""
    if mention.count(":") < 7 and ("::" not in mention or len(mention.strip(":")) < 6):
        return None
    try:
        return ipaddress.IPv6Address(mention).compressed
    except ValueError:
        return None


def script_of(name: str) -> str:
    """latin, cyrillic or greek, by the first letter."""
    first = name[0].lower()
    return "cyrillic" if "\u0400" <= first <= "\u04ff" else "greek" if "\u0370" <= first <= "\u03ff" or "\u1f00" <= first <= "\u1fff" else "latin"


def _again(text: str, names: dict[str, str]) -> Iterator[tuple[int, int, str, str]]:
    """Whole-word mentions of ``names`` (as written, with their kinds), also in capitals; one pass however many there are."""
    written = {w: n for n in names for w in (n.upper(), n)}
    by_first: dict[str, list[str]] = {}
    for name in sorted(written, key=len, reverse=True):
        by_first.setdefault(_WORDS(name)[0], []).append(name)
    for m in re.finditer(r"\w+", text):
        for name in by_first.get(m[0], ()):
            stop = m.start() + len(name)
            if text.startswith(name, m.start()) and not (text[stop : stop + 1].isalnum() or text[stop : stop + 1] == "_"):
                yield m.start(), stop, names[written[name]], written[name].lower()
                break


def _capital(word: str | None) -> bool:
    return bool(word) and word[0].isupper()


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of every mention, in order, none overlapping another."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at  # the walk ends at the @ before at the latest, so no character is passed twice
            while start and LOCAL(text[start - 1]):
                start -= 1
            start = at - len(text[start:at].lstrip(".+-%"))
            if start < at:
                found.append((start, domain.end(), "EMAIL", text[start : domain.end()].lower()))
        at = text.find("@", at + 1)
    if re.search(r"\d", text):
        for m in NUMBERS.finditer(text):
            kind = next(k for k in ("IP", "IBAN", "TOKEN", "CARD", "SSN", "PHONE") if m[k])
            entity = m[0] if kind in ("IP", "TOKEN") else re.sub(r"\W", "", m[0])
            if kind == "IBAN" and not _iban_ok(entity):
                continue
            found.append((m.start(), m.end(), kind, entity))
    if any(k in text for k in KEYS):
        found += [(*m.span(), "SECRET", m[0]) for m in SECRETS.finditer(text)]
    if _COLONS(text):
        found += [(*m.span(), "IP6", address) for m in IP6.finditer(text) if (address := _ip6(m[0]))]
    for m in NAMES.finditer(text) if not _TRIGGERS.isdisjoint(_WORDS(text)) else ():
        if m["title"]:
            gender = _GENDER[m["title"].lower()]
            if not _capital(m["a"]):
                continue
            if _capital(m["b"]):
                known = _GENDER.get(m["a"].lower())
                gender = known if gender == "U" and known else gender
                found.append((*m.span("a"), f"GIVEN_{gender}", m["a"].lower()))
                found.append((*m.span("b"), "SURNAME", m["b"].lower()))
            else:
                found.append((*m.span("a"), "SURNAME", m["a"].lower()))
        elif _capital(m["surname"]):
            found.append((*m.span("given"), f"GIVEN_{_GENDER[m['given'].lower()]}", m["given"].lower()))
            found.append((*m.span("surname"), "SURNAME", m["surname"].lower()))
    # the same person again, by either name alone; a title or known name tells the gender for the whole text
    told = {e: k for *_, k, e in found if k in ("GIVEN_M", "GIVEN_F")}
    found = [(a, b, told.get(e, k) if k == "GIVEN_U" else k, e) for a, b, k, e in found]
    given = {text[a:b]: kind for a, b, kind, _ in found if kind.startswith("GIVEN")}
    people = given | {text[a:b]: kind for a, b, kind, _ in found if kind == "SURNAME"}
    if people:
        found += _again(text, people)
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


class _Stream:
    """Numbers from a keyed hash of the kind, the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{entity}\0{attempt}".encode(), hashlib.sha256).digest()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def digit(self, old: str) -> str:
        """A digit; one that may lead a number if the old one was not 0."""
        return str(self.below(10))

    def letter(self, old: str) -> str:
        """A letter of the old one's script and case."""
        if "a" <= old <= "z":
            return "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
        if "A" <= old <= "Z":
            return self.letter(old.lower()).upper()
        near = ord(old) & ~63
        pool = [c for c in map(chr, range(near, near + 64)) if c.isalpha() and c.islower() == old.islower() and c.lower() == c]
        return pool[self.below(len(pool))] if pool else old

    def like(self, text: str) -> str:
        return "".join(self.digit(c) if c.isdigit() else self.letter(c) if c.isalpha() else c for c in text)

    def name(self, syllables: int, script: str = "latin") -> str:
        one, two = SYLLABLES[script]
        return "".join(one[self.below(len(one))] + two[self.below(len(two))] for _ in range(syllables))


def candidate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The stand-in that an entity draws in an attempt, in the entity's normal form."""
    s = _Stream(key, kind, entity, attempt)
    grown = max(0, attempt - GROW + 1)
    if kind == "EMAIL":
        local, _, domain = entity.partition("@")
        hosts = domain.split(".")[:-2]
        new = s.like(local) + s.name(grown)
        return new + "@" + ".".join([*map(s.like, hosts), "example", ("com", "org", "net")[s.below(3)]])
    if kind == "IP":
        a, b, *_ = entity.split(".")
        private = [a] if a == "10" else [a, b] if (a, b) == ("192", "168") or (a == "172" and 16 <= int(b) <= 31) else []
        if not private:
            first = s.below(223) + 1
            while first in (10, 127, 172, 192):
                first = s.below(223) + 1
            private = [str(first)]
        return ".".join(private + [str(s.below(254) + 1) for _ in range(4 - len(private))])
    if kind == "IBAN":
        body = "".join(s.digit(c) if c.isdigit() else s.letter(c.lower()).upper() for c in entity[4:])
        rest = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
        return f"{entity[:2]}{98 - rest:02d}{body}"
    if kind == "IP6":
        # the layout of groups stays, so a short form stays short; groups grow when short ones run out
        widths = [min(4, len(group) + grown) if group else 0 for group in entity.split(":")]
        return ":".join("".join("123456789abcdef"[s.below(15)] for _ in range(w)) for w in widths)
    if kind == "SECRET":
        lead = SECRETS.match(entity)["lead"]
        return lead + s.like(entity[len(lead) :])
    if kind == "TOKEN":
        return "".join("0123456789abcdef"[s.below(16)] for _ in entity)
    if kind == "CARD":
        body = entity[0] + "".join(s.digit(c) for c in entity[1:-1])
        fits = next(d for d in "0123456789" if luhn_ok(body + d))
        return body + (fits if luhn_ok(entity) else str((int(fits) + 1 + s.below(9)) % 10))
    if kind == "PHONE":
        # the calling code stays, unless the numbers behind it run out
        code = 1 if grown else next((n for n in (1, 2) if entity[:n] in CALLING), 3)
        return entity[:code] + "".join(s.digit(c) for c in entity[code:])
    if kind == "SSN":
        return entity[0] + "".join(s.digit(c) for c in entity[1:])
    # a double name stays one
    first, *more = re.split(r"(['’-])", entity)
    tail = "".join(p if p in "'’-" else s.name(2, script_of(p)) for p in more if p)
    script = script_of(first)
    if kind == "SURNAME":
        return s.name(3 + grown, script) + tail
    if attempt < 2:
        pool = {"latin": GIVEN, "cyrillic": GIVEN_CYRILLIC, "greek": GIVEN_GREEK}[script][kind[-1]]
        return pool[s.below(len(pool))].lower() + tail
    ends = ENDINGS[script][kind[-1]]
    return s.name(1 + attempt // 3, script) + ends[s.below(len(ends))] + tail


def render(mention: str, kind: str, stand_in: str) -> str:
    """The stand-in written as the mention is: its separators, its case."""
    if kind in ("CARD", "SSN", "PHONE", "IBAN"):
        left = iter(stand_in)
        return "".join(next(left) if c.isalnum() else c for c in mention)
    if mention.isupper() and len(mention) > 1:
        return stand_in.upper()
    if kind in ("SURNAME", "GIVEN_M", "GIVEN_F", "GIVEN_U"):
        old, new = re.split(r"(['’-])", mention), re.split(r"(['’-])", stand_in)
        return "".join(n.capitalize() if o[:1].isupper() else n for o, n in zip(old, new, strict=True))
    return stand_in


def stand_ins(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, stand_in) for distinct (kind, entity): no stand_in twice in a kind, none an entity of it.

    Of the entities that draw the same free stand-in the first keeps it; the others, and those that
    drew a real entity or one already given, draw again in the next round.
    """

    def drawing(attempt: int):
        @F.arrow_udf("string")
        def draw(kind: pa.Array, entity: pa.Array) -> pa.Array:
            return pa.array([candidate(key, k, e, attempt) for k, e in zip(kind.to_pylist(), entity.to_pylist(), strict=True)], pa.string())

        return draw

    pending, given, attempt, before, stalled = entities, None, 0, None, 0
    while True:
        drawn = stage(pending.withColumn("stand_in", drawing(attempt)("kind", "entity")), "drawn")
        free = drawn.join(entities.withColumnRenamed("entity", "stand_in"), ["kind", "stand_in"], "left_anti")
        if given is not None:
            free = free.join(given, ["kind", "stand_in"], "left_anti")
        won = free.groupBy("kind", "stand_in").agg(F.min("entity").alias("entity")).select("kind", "entity", "stand_in")
        given = stage(won if given is None else given.unionAll(won), "stand-ins")
        pending = drawn.select("kind", "entity").join(given, ["kind", "entity"], "left_anti")
        left = pending.count()
        if not left:
            return given
        stalled = stalled + 1 if left == before else 0
        if stalled >= STALLED:
            raise ValueError(f"no free stand-ins are left for {left} entities")
        before, attempt = left, attempt + 1


_SPANS = "array<struct<start:int,stop:int,kind:string,entity:string>>"


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with stand-ins for mentions in ``text``, and the added columns n_mentions (long) and kinds
    (array of the kinds mentioned, sorted); all other columns as they were.

    Kinds: EMAIL, IP, IP6, IBAN (valid ones), TOKEN (hexadecimal, 24 digits or more), SECRET (keys that begin as in
    ``KEYS``; the beginning stays), CARD, SSN, PHONE (the calling code stays), and GIVEN_M/F/U and SURNAME of people named
    after a title or by a known given name, also where either name recurs alone in that text. Equal keys give equal
    stand-ins for the same corpus. Null and empty texts stay as they are and mention nothing; repeated
    rows get equal results; input columns named like an added one are replaced. A text without
    mentions comes back unchanged and is not shuffled. Texts are searched once; the rows are staged with what was found.
    """

    @F.arrow_udf(_SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("entity", pa.string())]))
        for texts in batches:
            found = [[dict(zip(("start", "stop", "kind", "entity"), m, strict=True)) for m in mentions(t)] for t in texts.to_pylist()]
            yield pa.array(found, kind)

    @F.arrow_udf("string")
    def replace(texts: pa.Array, spans: pa.Array, chosen: pa.Array) -> pa.Array:
        out = []
        for text, found, pairs in zip(texts.to_pylist(), spans.to_pylist(), chosen.to_pylist(), strict=True):
            new = {(p["kind"], p["entity"]): p["stand_in"] for p in pairs}
            done, parts = 0, []
            for m in found:
                old = text[m["start"] : m["stop"]]
                parts += [text[done : m["start"]], render(old, m["kind"], new[m["kind"], m["entity"]])]
                done = m["stop"]
            out.append("".join([*parts, text[done:]]))
        return pa.array(out, pa.string())

    added = ("n_mentions", "kinds")
    row = F.struct(*[c for c in docs.columns if c not in added]).alias("_row")
    seen = stage(docs.select(row, F.col("doc_id").alias("_doc"), text_key().alias("_key"), find("text").alias("_found")), "searched")
    spoken = stage(seen.where(F.size("_found") > 0).select("_doc", "_key", "_found").distinct(), "mentions")
    each = spoken.select("_doc", "_key", F.explode("_found").alias("m")).select("_doc", "_key", "m.kind", "m.entity").distinct()
    given = stand_ins(stage(each.select("kind", "entity").distinct(), "entities"), key)
    chosen = each.join(given, ["kind", "entity"]).groupBy(F.col("_doc").alias("_id"), F.col("_key").alias("_text"))
    chosen = chosen.agg(F.collect_list(F.struct("kind", "entity", "stand_in")).alias("_chosen"))

    def shown(rows: DataFrame, text) -> DataFrame:
        same = [(text if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c not in added]
        kinds = F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["kind"])))
        return rows.select(*same, F.size("_found").cast("long").alias("n_mentions"), kinds.alias("kinds"))

    named = seen.where(F.size("_found") > 0)
    named = named.join(chosen, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")))
    named = named.withColumn("_new", replace("_row.text", "_found", "_chosen"))
    return shown(named, F.col("_new")).unionAll(shown(seen.where(F.size("_found") == 0), F.col("_row.text")))
