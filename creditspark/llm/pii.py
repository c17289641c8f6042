"""Surrogates for personal data and secrets.

Detected entities are e-mail addresses, IPv4 addresses, payment cards (valid check digit), telephone numbers, social security
numbers, access keys, values of password or token assignments, and names (known given names with a surname, or
names after a title).  Each is replaced by a keyed surrogate of the same type and format:

* letters stay letters of the same script and case, digits stay digits, marks and length stay; cards keep a
  valid check digit, addresses valid octets, telephone numbers their country code and valid area codes;
* a known given name becomes one of the same gender and script, a known surname one of the same script;
* a given name or surname found in full is followed: where it stands alone in the same text, before or after, it
  gets the same surrogate.

Not detected: people whose given name is in no table and who have no title, names in other letters than Latin, Cyrillic
and Greek, names written without capitals or all in capitals, further parts of a name (initials, second surnames, parts
after a hyphen), and inflected forms of a name.

The surrogate of an entity is a keyed permutation of all values of its format, a Feistel network, conjugated
with a shift so that nothing maps to itself.  Being a permutation, it gives different entities different surrogates and the
same entity the same one in every document and spelling (case of addresses, separators of
numbers), with no table of entities.  `collisions` checks exactly that over all documents; `protect` runs it first and
refuses to go on if it finds one.

A row of digit groups is a card if its check digit is valid; otherwise the cards inside it are looked for, in one group or in
the groups that cards are printed in (any borders would make cards of most lists of numbers).

Defined cases: a null text stays null, an empty one empty; texts without entities pass unchanged; repeated rows are handled
each; extra columns are kept; an entity does not extend over a line end.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from creditspark.llm.common import pieces

KEY = "training-corpus"

#: Given names by script and gender, surnames by script (fixed values of this module).
GIVEN = {
    ("latin", "f"): tuple((
        "Anna Maria Julia Laura Sophie Claire Elena Carmen Emily Sarah Hannah Camille Emma Olivia Sophia Isabella Amelia Evelyn "
        "Abigail Elizabeth Margaret Jennifer Jessica Patricia Linda Barbara Susan Karen Nancy Lisa Sandra Ashley Kimberly Donna "
        "Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Rachel Catherine Katherine Christine Nicole Samantha Helen Alice "
        "Julie Martha Megan Lauren Andrea Hanna Lena Lea Mia Clara Johanna Katharina Sabine Petra Monika Ursula Brigitte Ingrid "
        "Heike Birgit Greta Frieda Marie Louise Juliette Chloé Manon Inès Élodie Aurélie Céline Hélène Françoise Isabelle Nathalie "
        "Valérie Sylvie Monique Lucía Sofía Martina Paula Daniela Valentina Isabel Pilar Ana Marta Cristina Rosa Raquel Silvia "
        "Giulia Chiara Francesca Alessia Federica Giovanna Lucia Agnieszka Katarzyna Ewa Zofia Fatima Aisha Leila Priya Yuki").split()),
    ("latin", "m"): tuple((
        "John Thomas Peter Michael David Pierre Carlos Miguel Lukas Daniel Robert Andreas James William Richard Joseph Charles "
        "Christopher Matthew Anthony Steven Stephen Andrew Paul Joshua Kenneth Kevin Brian George Timothy Ronald Edward Jason "
        "Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Jack "
        "Henry Oliver Liam Noah Ethan Lucas Nathan Adam Simon Philip Martin Hans Jürgen Klaus Wolfgang Stefan Markus Matthias "
        "Sebastian Tobias Florian Felix Jonas Maximilian Friedrich Heinrich Karl Jean Jacques François Philippe Alain Nicolas "
        "Laurent Julien Antoine Olivier Étienne Mathieu Guillaume José Juan Luis Javier Francisco Antonio Manuel Pedro Pablo "
        "Alejandro Fernando Diego Sergio Rafael Jorge Marco Giuseppe Giovanni Luca Matteo Alessandro Paolo Piotr Krzysztof "
        "Tomasz Jan Lars Sven Erik Mohammed Ahmed Omar Hassan Ali Raj Wei Hiroshi").split()),
    ("cyrillic", "f"): tuple((
        "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Анастасия Юлия Дарья Ксения Полина Александра Людмила "
        "Галина Валентина Нина Марина Алина Виктория Софья София Оксана Лариса").split()),
    ("cyrillic", "m"): tuple((
        "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел Александр Владимир Евгений Максим Артём Артем Юрий Виктор Олег "
        "Игорь Константин Антон Роман Кирилл Никита Василий Борис Григорий Пётр Денис Илья Фёдор").split()),
    ("greek", "f"): tuple((
        "Μαρία Ελένη Αικατερίνη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Κωνσταντίνα Παναγιώτα Ιωάννα Άννα Ευαγγελία "
        "Χριστίνα Αναστασία Ειρήνη").split()),
    ("greek", "m"): tuple((
        "Γεώργιος Γιώργος Ιωάννης Γιάννης Κωνσταντίνος Κώστας Δημήτριος Δημήτρης Νικόλαος Νίκος Παναγιώτης Βασίλειος Βασίλης Χρήστος "
        "Αθανάσιος Θανάσης Μιχαήλ Μιχάλης Ευάγγελος Σπύρος Αντώνης Ανδρέας Παύλος").split()),
}
SURNAMES = {
    "latin": ("Smith", "Johnson", "Miller", "Brown", "Schmidt", "Müller", "Weber", "Fischer", "Martin", "Dubois", "Moreau",
              "García", "López", "Fernández", "Rossi", "Novak"),
    "cyrillic": ("Смирнов", "Петров", "Соколов", "Попов", "Лебедев", "Козлов", "Новиков", "Морозов"),
    "greek": ("Παπαδόπουλος", "Γεωργίου", "Δημητρίου", "Νικολάου", "Ιωάννου", "Βασιλείου", "Οικονόμου", "Αντωνίου"),
}
_TITLES = ("Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Signora|Signor|Господин|Госпожа"
           "|Κύριος|Κύριε|Κυρία")
#: Words that a title may precede without being a name: they are no names elsewhere in the text.
_NO_NAMES = frozenset(
    "The This That These Those There Then They And But For From His Her Its Our Your You Who What When Where Why How Not With "
    "Will Would Can Could Has Have Had Was Were Are One All Any Some Please Chair Chairman President Speaker Minister "
    "Die Der Das Und Ein Eine Ich Sie Wir Ist Les Des Une Est Vous Nous Los Las Una Con Por Que Para".split())
_GIVEN_OF = {n: k for k, names in GIVEN.items() for n in names}
_SURNAME_OF = {n: k for k, names in SURNAMES.items() for n in names}
_ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_LETTER = {c: a for a in _ALPHABETS.values() for c in a}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ENTITY = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9_][A-Za-z0-9_.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<access>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret>[^\s\"',;]{6,})"
    r"|(?P<ip>(?<![\w.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
    r"|(?<![\w+])\+(?!1\b)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}(?!\d)){1,4})"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\d))")
#: Digits per group of cards as they are printed; cards in one group are printed too.
_PRINTED = frozenset([
    (4, 4, 4, 4), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3), (4, 4, 4, 1), (4, 4, 4, 2), (4, 4, 4, 3), (4, 4, 5),
    (4, 5, 6), (4, 6, 4), (4, 6, 5), (4, 3, 3, 3), (5, 4, 4), (6, 13), (8, 8)])
_ROW = re.compile(r"\d+(?:[ -]\d+)*")
_DIGITS = re.compile(r"\d+")
_HINT = re.compile(r"[@0-9]|[Pp]ass|PASS|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Kk]ey|KEY|AKIA")
_UPPER = "A-Z" + "".join(c for c in map(chr, range(0xC0, 0x530)) if c.isupper())
_CAPITAL = re.compile(rf"\b[{_UPPER}]\w+")
_NAME = re.compile(
    rf"\b(?P<title>{_TITLES})\b\.? +(?P<one>[{_UPPER}][^\W\d_]+)(?: +(?P<two>[{_UPPER}][^\W\d_]+))?"
    rf"|\b(?P<given>{'|'.join(_GIVEN_OF)}) +(?P<last>[{_UPPER}][^\W\d_]+)")
_NAME_WORDS = frozenset([*_GIVEN_OF, *_TITLES.split("|")])


# --- keyed permutations -----------------------------------------------------


def _round(key: str, i: int, value: int, size: int) -> int:
    bits = hashlib.blake2b(f"{i}|{value}".encode(), key=hashlib.sha256(key.encode()).digest(), digest_size=32)
    return int.from_bytes(bits.digest(), "big") % size


def _feistel(x: int, size: int, key: str, back: bool = False) -> int:
    """A permutation of 0 .. size - 1 (or its inverse): six rounds on two halves, repeated while outside."""
    half = isqrt(size - 1) + 1
    while True:
        a, b = divmod(x, half)
        for i in range(5, -1, -1) if back else range(6):
            if back:
                a, b = (b - _round(key, i, a, half)) % half, a
            else:
                a, b = b, (a + _round(key, i, b, half)) % half
        x = a * half + b
        if x < size:
            return x


def permuted(x: int, size: int, key: str) -> int:
    """A keyed permutation of 0 .. size - 1 without fixed points (for size > 1)."""
    if size < 2:
        return x
    shift = 1 + _round(key, 99, size, size - 1)
    return _feistel((_feistel(x, size, key) + shift) % size, size, key, back=True)


def _mixed(digits: list[int], sizes: list[int], key: str) -> list[int]:
    """Digits of a mixed-radix number, permuted as one number."""
    value, size = 0, 1
    for d, n in zip(digits, sizes):
        value, size = value * n + d, size * n
    value = permuted(value, size, key)
    out = []
    for n in reversed(sizes):
        value, d = divmod(value, n)
        out.append(d)
    return out[::-1]


def _characters(text: str, key: str, hexadecimal: bool = False) -> str:
    """Letters and digits permuted inside their alphabets; case and everything else stays in place."""
    alphabets = []
    for c in text:
        low = c.lower()
        if hexadecimal:
            alphabets.append("0123456789abcdef")
        elif c in "0123456789":
            alphabets.append("0123456789")
        else:  # a sign such as that of Kelvin, whose small letter has another capital, stays
            alphabets.append(_LETTER.get(low, "") if c in (low, low.upper()) else "")
    at = [i for i, a in enumerate(alphabets) if a]
    if not at:
        return text
    shape = "".join(f"{len(a)}." if a else c.lower() for c, a in zip(text, alphabets))
    made = _mixed([alphabets[i].index(text[i].lower()) for i in at], [len(alphabets[i]) for i in at], f"{key}|{shape}")
    out = list(text)
    for i, d in zip(at, made):
        c = alphabets[i][d]
        out[i] = c.upper() if text[i].isupper() else c
    return "".join(out)


# --- surrogates by type -----------------------------------------------------


_RESERVED = re.compile(r"\.example$", re.I)


def _email(text: str, key: str) -> str:
    front, dot, end = text.rpartition(".")
    reserved = _RESERVED.search(front)
    if reserved:
        front, end = front[:reserved.start()], front[reserved.start() + 1:] + dot + end
    out = _characters(front, f"{key}|{end.lower()}")
    while not reserved and _RESERVED.search(out):
        out = _characters(out, f"{key}|{end.lower()}")
    return out + "." + end


def _ip(text: str, key: str) -> str:
    a, *rest = map(int, text.split("."))
    low, n = (1, 223) if 1 <= a <= 223 else (224, 32) if a >= 224 else (0, 1)
    made = _mixed([a - low, *rest], [n, 256, 256, 256], f"{key}|{low}")
    return ".".join(map(str, [made[0] + low, *made[1:]]))


def _check_digit(digits: list[int]) -> int:
    doubled = [sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(reversed(digits))]
    return -sum(doubled) % 10


def is_card(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    return 13 <= len(digits) <= 19 and _check_digit(digits[:-1]) == digits[-1]


def _put(text: str, digits: list[int]) -> str:
    source = iter(digits)
    return "".join(str(next(source)) if c.isdigit() else c for c in text)


def _card(text: str, key: str) -> str:
    digits = [int(c) for c in text if c.isdigit()]
    made = [digits[0], *_mixed(digits[1:-1], [10] * (len(digits) - 2), f"{key}|{digits[0]}|{len(digits)}")]
    return _put(text, [*made, _check_digit(made)])


_FICTION = [5, 5, 5]  # the exchange that is kept for fiction


def _american(digits: list[int]) -> bool:
    return len(digits) == 10 or len(digits) == 11 and digits[0] == 1


def _phone(text: str, key: str) -> str:
    digits = [int(c) for c in text if c.isdigit()]
    american = _american(digits)
    kept = len(digits) - 10 if american else min(2, len(digits) - 1)
    own = digits[kept:]
    fixed = american and own[3:6] == _FICTION
    if american:  # an area code or exchange that begins with 0 or 1 is none, and its surrogate is none
        low = [2 if i in (0, 3) and d >= 2 else 0 for i, d in enumerate(own)]
        sizes = [1 if fixed and 3 <= i < 6 else 10 if i not in (0, 3) else 8 if n else 2 for i, n in enumerate(low)]
        low = [d if n == 1 else b for d, n, b in zip(own, sizes, low)]
        shape = f"a|{low}"
    else:
        low, sizes, shape = [0] * len(own), [10] * len(own), f"{digits[:kept]}|{len(own)}"
    while True:
        own = [d + b for d, b in zip(_mixed([d - b for d, b in zip(own, low)], sizes, f"{key}|{shape}"), low)]
        if fixed or not american or own[3:6] != _FICTION:  # other numbers go on until they leave that exchange
            return _put(text, digits[:kept] + own)


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def _secret(text: str, key: str) -> str:
    """Hexadecimal stays hexadecimal of the same case; others go on until the outcome is not, so they never meet.

    Digits alone count as small letters, so capitals go on until there is one.
    """
    hexadecimal = _HEX.fullmatch(text) is not None
    if not hexadecimal:
        out = _characters(text, key)
        while _HEX.fullmatch(out):
            out = _characters(out, key)
        return out
    out = _characters(text.lower(), key, hexadecimal=True)
    while text != text.lower() and out.isdigit():
        out = _characters(out, key, hexadecimal=True)
    return out if text == text.lower() else out.upper()


def _from_list(name: str, names: tuple[str, ...], key: str) -> str:
    return names[permuted(names.index(name), len(names), key)]


def given_name(name: str, key: str) -> str:
    kind = _GIVEN_OF.get(name)
    return _from_list(name, GIVEN[kind], f"{key}|given|{kind}") if kind else _unlisted(name, key, _GIVEN_OF)


def surname(name: str, key: str) -> str:
    script = _SURNAME_OF.get(name)
    return _from_list(name, SURNAMES[script], f"{key}|surname|{script}") if script else _unlisted(name, key, _SURNAME_OF)


def _unlisted(name: str, key: str, listed: dict) -> str:
    """Letter by letter, going on while the outcome is a listed name: still a permutation of the unlisted names."""
    out = _characters(name, f"{key}|name")
    while out in listed:
        out = _characters(out, f"{key}|name")
    return out


_BY_KIND: dict[str, Callable[[str, str], str]] = {
    "email": _email, "ip": _ip, "card": _card, "phone": _phone, "secret": _secret,
    "access": lambda t, k: "AKIA" + _characters(t[4:], k),
    "ssn": lambda t, k: _characters(t, k),
    "given": given_name, "surname": surname,
}


@lru_cache(maxsize=20_000)
def surrogate(kind: str, text: str, key: str = KEY) -> str:
    return _BY_KIND[kind](text, f"{key}|{kind}")


# --- texts -------------------------------------------------------------------


def _apart(spans: list[tuple], found: list[tuple[int, int, str]]) -> bool:
    return all(e <= a or s >= b for s, e, *_ in spans for a, b, _ in found)


def _cards(line: str, start: int) -> tuple[list[tuple[int, int, str]], int]:
    """Cards among the digit groups of the row that begins at `start`, the longest first, and the end of the row."""
    end = _ROW.match(line, start).end()
    groups = [g.span() for g in _DIGITS.finditer(line, start, end)]
    valid = []
    for i, (a, _) in enumerate(groups):
        sizes: tuple[int, ...] = ()
        for p, q in groups[i:i + 5]:
            sizes += (q - p,)
            if (len(sizes) == 1 or sizes in _PRINTED) and is_card(line[a:q]):
                valid.append((-sum(sizes), a, q))
    out: list[tuple[int, int, str]] = []
    taken: set[int] = set()  # starts of groups that are taken
    for _, a, q in sorted(valid):
        own = {p for p, _ in groups[bisect_left(groups, (a,)):bisect_left(groups, (q,))]}
        if taken.isdisjoint(own):
            taken |= own
            out.append((a, q, "card"))
    return out, end


def _spans(line: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the entities of a line, in order, without overlaps."""
    found, cards = [], []
    if _HINT.search(line):
        at = row = 0
        while m := _ENTITY.search(line, at):
            kind, at = m.lastgroup, m.end()
            if kind != "card" or m.start() >= row and is_card(m["card"]):
                found.append((*m.span(kind), kind))
                continue
            at = m.start() + 1  # other entities may begin inside
            if m.start() >= row:
                more, row = _cards(line, m.start())
                cards += more
        if cards:
            others = list(found)
            found += [c for c in cards if _apart([c], others)]
    if not _NAME_WORDS.isdisjoint(_CAPITAL.findall(line)):
        for m in _NAME.finditer(line):
            if m["title"]:
                parts = [("one", "given" if m["two"] else "surname"), ("two", "surname")]
            else:
                parts = [("given", "given"), ("last", "surname")]
            spans = [(*m.span(g), kind) for g, kind in parts if m[g]]
            if _apart(spans, found):
                found += spans
    return sorted(found)


def _with_mentions(line: str, spans: list[tuple[int, int, str]], names: dict[str, str]) -> list[tuple[int, int, str]]:
    """The entities of a line, and the bare mentions of names that the text has in full somewhere."""
    more = [(*m.span(), names[m[0]]) for m in _CAPITAL.finditer(line) if m[0] in names]
    return sorted(spans + [x for x in more if _apart([x], spans)])


def replaced(text: str, key: str = KEY) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each replacement."""
    out, made = [], []
    lines = text.split("\n")
    found = [_spans(line) for line in lines]
    names: dict[str, str] = {}
    for line, spans in zip(lines, found):
        for start, end, kind in spans:
            if kind in ("given", "surname") and line[start:end] not in _NO_NAMES:
                names.setdefault(line[start:end], kind)
    for line, spans in zip(lines, found):
        at, parts = 0, []
        for start, end, kind in _with_mentions(line, spans, names) if names else spans:
            new = surrogate(kind, line[start:end], key)
            made.append((kind, line[start:end], new))
            parts += [line[at:start], new]
            at = end
        out.append("".join([*parts, line[at:]]) if parts else line)
    return "\n".join(out), made


def _same(kind: str, text: str) -> str:
    """The spelling under which an entity counts as the same; a phone number with its country, but for the 1 before ten digits."""
    if kind in ("given", "surname", "secret", "access"):
        return text
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(n)) for n in text.split("."))
    digits = "".join(c if kind == "ssn" else str(int(c)) for c in text if c.isdigit())
    return digits[-10:] if kind == "phone" and _american([int(c) for c in digits]) else digits


def entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """kind, entity and surrogate of every replacement, in normal spelling, once per batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            made = sorted({(k, _same(k, a), _same(k, s)) for t in b.column("text") for k, a, s in replaced(t.as_py() or "", key)[1]})
            columns = list(zip(*made)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "entity", "surrogate"])

    return docs.select("text").mapInArrow(run, "kind string, entity string, surrogate string")


def collisions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Surrogates shared by different entities, and entities with more than one surrogate; no rows if all is well."""
    pairs = entities(docs, key)
    shared = pairs.groupBy("kind", F.col("surrogate").alias("value")).agg(
        F.min("entity").alias("one"), F.max("entity").alias("other")).where("one <> other")
    split = pairs.groupBy("kind", F.col("entity").alias("value")).agg(
        F.min("surrogate").alias("one"), F.max("surrogate").alias("other")).where("one <> other")
    return shared.unionByName(split)


def protect(docs: DataFrame, key: str = KEY, check: bool = True) -> DataFrame:
    """The rows and columns of `docs` with surrogates in `text`, and n_entities, the number of replacements."""
    if check and (bad := collisions(docs, key).limit(1).collect()):
        raise ValueError(f"surrogates of {bad[0]['kind']} entities collide")
    columns = [c for c in docs.columns if c != "n_entities"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            made = [(None, []) if t.as_py() is None else replaced(t.as_py(), key) for t in b.column("text")]
            arrays = [b.column(c) if c != "text" else pa.array([m[0] for m in made], pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array([len(m[1]) for m in made], pa.int32())], [*columns, "n_entities"])

    schema = docs.select(*columns).schema.add("n_entities", IntegerType())
    return docs.select(*columns).mapInArrow(run, schema)
