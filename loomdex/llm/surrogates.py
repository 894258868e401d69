"""PII: detected entities receive keyed surrogates of the same type and form.

Detection reads whole texts: addresses of mail, telephone numbers, IPv4 (not after "version" and the like), IPv6 and hardware addresses,
social-security-like numbers, IBANs, payment cards (12 to 19 digits with a right check digit), account numbers after a cue, secrets (quoted or
assigned tokens, long hexadecimal strings, known key prefixes), and names after titles or introducing phrases, or that begin with a listed given
name and go on with a capital. A name takes all capitalised words, initials, compounds (O'Brien, Smith-Jones) and small words between them (de la,
von) up to one of ``_ENDS`` or another title, in text of capitals at most four words; small words, and the letter of O' or d', stay. Each part of a
name so found, in capitals too, is then replaced wherever else it stands in the text as a whole word. Names without any such sign are not found.
Telephone numbers without a country's code and numbers of identity papers are found after a cue; the letters of the latter stay.

An entity is first brought to its canonical form, so that one entity in several spellings has one surrogate (coreference): digits without
separators and of any script, mail and hardware addresses in lower case, telephone numbers split by the rule of country codes. The surrogate is then
written as the entity was: its separators, script, and upper case.

A surrogate is a permutation of the canonical form, so no table of entities has to be built, joined or kept: the characters of each
alphabet (digits, hexadecimal digits, letters of one script and case) are a number in that base, which goes through a keyed Feistel
permutation P, one step along the ring of all such numbers, and P backwards. Two entities of one form so never share a surrogate
(distinctness), an entity has the same one in every document, and none is its own. Where a form has rules (a Luhn digit, octets
under 256, private or public networks, check digits), the permutation is walked on until the result keeps them as the entity did, which collides
with nothing either; an IBAN's check digits move by what the right ones move, so wrong ones stay wrong and distinct. In long entities P works on two
halves of characters instead of numbers, in linear time. Given names come from lists by script and gender; they step along a keyed ring of their list.
Names that are on no list are permuted, vowels among vowels and consonants among consonants, and walked on while they hit a list.

While a text is replaced, each surrogate is checked: two different originals of a text never get one, or the job stops. ``collisions`` checks
the same over a table of entities.

Defined cases: null text stays null; texts without entities stay as they are; an entity is replaced at each place it stands; single characters
of an alphabet step along its ring; CJK and other scripts without case are left as they are but for digits; repeated rows, empty tables and
other columns are no special case.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import map_batches, slices

KEY = b"surrogates-1"
ROUNDS, LONG = 8, 48

# ---------------------------------------------------------------- permutations


def _number(key: bytes, tweak: bytes, *parts: int) -> int:
    said = [p.to_bytes(p.bit_length() // 8 + 1) for p in parts]
    return int.from_bytes(hashlib.blake2b(b"|".join([tweak, *(len(x).to_bytes(4) + x for x in said)]), key=key, digest_size=32).digest())


def _feistel(x: int, base: int, n: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of the numbers of n digits in a base, n at least 2."""
    low, high = base ** (n // 2), base ** (n - n // 2)
    a, b = divmod(x, low)  # a < high, b < low
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if k % 2:
            b = (b + sign * _number(key, tweak, k, n, base, a)) % low
        else:
            a = (a + sign * _number(key, tweak, k, n, base, b)) % high
    return a * low + b


def _mix_halves(x: np.ndarray, base: int, key: bytes, tweak: bytes, back: bool = False) -> np.ndarray:
    """A keyed permutation of rows of digits: each half in turn moves by a stream made from the other."""
    halves = [x[: len(x) // 2], x[len(x) // 2 :]]
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        own, other = halves[k % 2], halves[1 - k % 2]
        stream = hashlib.shake_256(b"|".join([key, tweak, b"%d|%d" % (k, base), other.astype(np.uint8).tobytes()])).digest(4 * len(own))
        move = (np.frombuffer(stream, "<u4") % base).astype(np.int64)
        halves[k % 2] = (own - move if back else own + move) % base
    return np.concatenate(halves)


def step_long(x: np.ndarray, base: int, key: bytes, tweak: bytes) -> np.ndarray:
    """As ``step``, for more digits than ``LONG``, given as an array: between P and P backwards, the first eight digits step along their ring."""
    y = _mix_halves(x, base, key, tweak)
    first = 0
    for d in y[:8].tolist():
        first = first * base + d
    first = step(first, base, 8, key, tweak)
    for i in range(7, -1, -1):
        first, y[i] = divmod(first, base)
    return _mix_halves(y, base, key, tweak, back=True)


def step(x: int, base: int, n: int, key: bytes, tweak: bytes) -> int:
    """The number after x on a keyed ring of all numbers of n digits: a permutation without fixed points."""
    size = base**n
    stride = 1 + _number(key, tweak, n, base) % (size - 1)
    if n == 1:
        return (x + stride) % size
    return _feistel((_feistel(x, base, n, key, tweak) + stride) % size, base, n, key, tweak, back=True)


@lru_cache(maxsize=1)
def alphabets() -> dict[str, str]:
    """Each character's alphabet: ASCII and other letters with case by script, digits by script."""
    out = {}
    groups = ["".join(map(chr, range(a, b + 1))) for a, b in ((0x61, 0x7A), (0x41, 0x5A), (0x3B1, 0x3C9), (0x391, 0x3A9), (0x430, 0x44F), (0x410, 0x42F))]
    latin = [c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and c.lower().upper() == c.upper() and c.upper().lower() == c.lower() and len(c.upper()) == 1]
    groups += ["".join(c for c in latin if c.islower()), "".join(c for c in latin if c.isupper())]
    groups += ["".join(map(chr, range(z, z + 10))) for z in range(sys.maxunicode) if unicodedata.decimal(chr(z), None) == 0]
    for g in groups:
        own = "".join(c for c in g if c.isalnum())
        out |= dict.fromkeys(own, own)
    return out


@lru_cache(maxsize=1)
def name_alphabets() -> dict[str, str]:
    """The same, with vowels and consonants apart, so that what is made of a name can be said."""
    out = {}
    for g in set(alphabets().values()):
        if g[0].isalpha():
            vowel = lambda c: unicodedata.normalize("NFD", c)[0].lower() in "aeiouyøæœıаеёиоуыэюяαεηιουω"
            for own in ("".join(filter(vowel, g)), "".join(c for c in g if not vowel(c))):
                out |= dict.fromkeys(own, own)
    return out


def permute(s: str, kind: str, key: bytes = KEY, alphabet: str | None = None, of: dict[str, str] | None = None) -> str:
    """Characters of each alphabet permuted together, all others left in place; with ``alphabet``, only that one; ``of`` has others than the usual."""
    of = dict.fromkeys(alphabet, alphabet) if alphabet else of or alphabets()
    places: dict[str, list[int]] = {}
    for i, c in enumerate(s):
        if g := of.get(c):
            places.setdefault(g, []).append(i)
    shape = hashlib.blake2b(repr((kind, [(g[0], at) for g, at in places.items()], "".join("" if c in of else c for c in s))).encode(), digest_size=8).digest()
    out = list(s)
    for g, at in places.items():
        if len(g) == 1:
            continue
        tweak, index = shape + g[:1].encode(), {c: k for k, c in enumerate(g)}
        if len(at) > LONG:
            digits = np.fromiter((index[s[i]] for i in at), np.int64, len(at))
            for i, d in zip(at, step_long(digits, len(g), key, tweak).tolist(), strict=True):
                out[i] = g[d]
            continue
        x = 0
        for i in at:
            x = x * len(g) + index[s[i]]
        x = step(x, len(g), len(at), key, tweak)
        for i in reversed(at):
            x, r = divmod(x, len(g))
            out[i] = g[r]
    return "".join(out)


def digits_of(s: str) -> str:
    """The decimal digits in it, of whatever script, as ASCII."""
    return "".join(str(unicodedata.decimal(c)) for c in s if c.isdecimal())


def as_digits(s: str, digits: str) -> str:
    """``s`` with other digits, each in the script of the one it replaces."""
    new = iter(digits)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(new))) if c.isdecimal() else c for c in s)


def as_case(s: str, lower: str) -> str:
    """``lower`` with upper case where ``s`` has it."""
    return "".join(x.upper() if c != c.lower() else x for c, x in zip(s, lower, strict=True))


def folded(s: str) -> str:
    """Lower case, but for characters that would change their number or not come back."""
    return "".join(low if len(low := c.lower()) == 1 and low.upper() == c else c for c in s)


def walk(s: str, kind: str, trait, key: bytes = KEY, alphabet: str | None = None) -> str:
    """Permute until the result has the entity's trait again: a permutation of each set of equal trait."""
    want, now = trait(s), permute(s, kind, key, alphabet)
    while trait(now) != want:
        now = permute(now, kind, key, alphabet)
    return now


# ---------------------------------------------------------------- types


def luhn(s: str) -> bool:
    digits = [int(c) for c in s if c.isdigit()]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def _plain_ipv4(s: str) -> bool:
    return all(int(p) < 256 and str(int(p)) == p for p in s.split("."))


def ipv4(s: str, key: bytes) -> str:
    """The next address of its class (private, multicast, loopback, other) on a ring of all; what is no plain address is permuted by digits."""
    if not _plain_ipv4(s):
        return walk(s, "ipv4-free", _plain_ipv4, key)
    trait = lambda a: (a.is_private, a.is_multicast, a.is_loopback)
    now = own = ipaddress.IPv4Address(s)
    while now == own or trait(now) != trait(own):
        now = ipaddress.IPv4Address(step(int(now), 256, 4, key, b"ipv4"))
    return str(now)


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def iban(s: str, key: bytes) -> str:
    """Country and spacing stay, account digits and letters are permuted, check digits move by as much as the right ones do."""
    compact = "".join(c for c in s if c.isalnum())
    country, check, account = compact[:2], digits_of(compact[2:4]), "".join(digits_of(c) or c for c in compact[4:])
    new = permute(account, "iban" + country, key)
    moved = (int(check) - _iban_check(country, account) + _iban_check(country, new)) % 100
    chars = iter(f"{country}{moved:02d}{new}")
    return "".join(next(chars) if c.isalnum() else c for c in s)


def email(s: str, key: bytes) -> str:
    """Local part and domain labels are permuted, the top-level domain stays; upper and lower case are one mailbox."""
    local, _, domain = folded(s).rpartition("@")
    name, dot, top = domain.rpartition(".")
    return as_case(s, permute(local, "email", key) + "@" + permute(name, "domain", key) + dot + top)


#: Country codes of one and two digits; all others have three (fixed values of the numbering plan).
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(s: str, key: bytes) -> str:
    """Country code and form stay, the other digits are permuted."""
    d = digits_of(s)
    n = next((k for k in (1, 2) if d[:k] in SHORT_CODES), 3) if s[0] == "+" else 0
    return as_digits(s, d[:n] + permute(d[n:], f"phone{s[0] == '+'}{d[:n]}", key))


def card(s: str, key: bytes) -> str:
    return as_digits(s, walk(digits_of(s), "digits", luhn, key))


def number(s: str, key: bytes) -> str:
    return as_digits(s, permute(digits_of(s), "number", key))


HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"


def secret(s: str, key: bytes) -> str:
    for g in (HEX_LOWER, HEX_UPPER):
        if all(c in g for c in s):
            for own in (g[:10], g[10:]):  # of digits or of letters alone: among their like, to which a walk would hardly ever come back
                if all(c in own for c in s):
                    return permute(s, "hex", key, own)
            return walk(s, "hex", lambda x: (any(c.isalpha() for c in x), any(c.isdigit() for c in x)), key, g)
    m = re.match(r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk-|xox[abprs]-|eyJ)", s)
    head = m[0] if m else ""
    return head + permute(s[len(head) :], "secret" + head, key)


def hexadecimal(s: str, key: bytes) -> str:
    """Hardware addresses in any writing are one; of IPv6 addresses letters in any case are."""
    low = s.lower()
    pairs = re.fullmatch(r"(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}", low)
    new = iter(permute(re.sub("[:-]", "", low) if pairs else low, "hardware" if pairs else "address", key, HEX_LOWER))
    out = "".join(c if c in ":-" and (pairs or next(new)) else next(new) for c in low)
    return out.upper() if re.search("[A-F]", s) else out


# ---------------------------------------------------------------- names

#: Given names by script and gender (fixed values).
NAMES = {
    ("latin", "f"): "Mary Anna Emma Laura Julia Sarah Sophie Marie Claire Elena Maria Lucia Carmen Ana Katharina Lena Hannah Ingrid Alice Rachel Susan Linda Nora Olivia Camille Isabel".split(),
    ("latin", "m"): "John James Peter Paul Thomas Michael David Daniel Martin Lukas Felix Stefan Hans Pierre Louis Antoine Jean Carlos Juan Diego Javier Robert William George Henry Oscar".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Андрей Николай Михаил Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παύλος".split(),
}
#: Titles after which a name comes (fixed values).
TITLES = "Mrs Ms Miss Frau Mme Madame Mlle Sra Señora Srta Doña Mr Herr Monsieur Sr Señor Don Dr Prof".split()
_BY_NAME = {n: k for k, names in NAMES.items() for n in names}
#: Small words inside names, which stay as they are (fixed values).
PARTICLES = "von van zu zum zur der den dem de del della di da do dos das du des la las los le el al bin ibn ben abu ter ten y e af av san st".split()
#: Capitals that end a name rather than go on with it (fixed values).
_ENDS = "The And Or For From By With Was Is Has Had He She It We You They Und".split()
_LETTER = "(?:[^\\W\\d_]|[\u0300-\u036f])"
_RUN = re.compile(f"{_LETTER}+")
_LOWER = "".join(c for c in map(chr, range(0x61, 0x2000)) if c.islower())
#: A letter that is none of lower case.
_CAPITAL = f"[^\\W\\d_{_LOWER}]"
_TITLES = "|".join(sorted([*TITLES, *map(str.upper, TITLES)], key=len, reverse=True))
_GAP = "[ \t\u00a0]+"
#: Small words that a hyphen or an apostrophe joins to a name (fixed values).
_JOINED = "al el an ar as ash d l dell dall".split()
#: A word of a name: never a title, with all that apostrophes and hyphens join to it but for a genitive's s.
_TAIL = f"{_LETTER}*(?:['\u2019\u2010\u2011-](?!s\\b){_LETTER}+)*"
_NAME_WORD = f"(?!(?:{_TITLES})\\b)(?:(?:{'|'.join(_JOINED)})['\u2019\u2010\u2011-])?{_CAPITAL}{_TAIL}"
_SMALL = f"(?:(?:{'|'.join(PARTICLES)}){_GAP}){{0,3}}"
#: What a name goes on with: further words and initials, small words before them.
_STAYS = frozenset([*PARTICLES, *_JOINED])
_ON = f"(?:(?:(?<=\\b{_CAPITAL})\\.)?{_GAP}{_SMALL}(?!(?:{'|'.join(_ENDS)})\\b){_NAME_WORD})"
_TITLE = re.compile(
    rf"\b(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?{_GAP}|(?:[Mm]y name is|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Nn]ame:){_GAP})"
    rf"(?P<n>{_SMALL}{_NAME_WORD}{_ON}*)"
)
#: In text of capitals a name's end can't be seen: at most four words belong to it.
_CAPITALS = re.compile(rf"\b(?:{'|'.join(sorted(map(str.upper, TITLES), key=len, reverse=True))})\b\.?{_GAP}(?P<n>{_NAME_WORD}{_ON}{{0,3}})")
_CALLED = re.compile(rf"\b(?:{'|'.join(sorted(_BY_NAME))})(?!{_LETTER})(?:['’‐‑-](?!s\b){_LETTER}+)*{_ON}+")


@lru_cache(maxsize=64)
def _ring(script: str, gender: str, key: bytes) -> list[str]:
    return sorted(NAMES[script, gender], key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())


def titled(word: str) -> str:
    """A word in capitals as it is written elsewhere; Greek, whose small letters capitals don't tell, and letters that would not come back stay."""
    low = word.capitalize()
    return low if len(word) > 1 and word.isupper() and low.upper() == word and len(low) == len(word) and not re.search("[\u0370-\u03ff]", word) else word


def given_name(name: str, key: bytes) -> str:
    """The next of its list, or, off the lists, a permutation of its letters that is on no list either; in capitals as its other writing."""
    if (low := titled(name)) != name:
        return given_name(low, key).upper()
    if own := _BY_NAME.get(name):
        ring = _ring(*own, key)
        return ring[(ring.index(name) + 1) % len(ring)]
    new = permute(name, "name", key, of=name_alphabets())
    while new in _BY_NAME or new in _STAYS:
        new = permute(new, "name", key, of=name_alphabets())
    return new


def person(s: str, key: bytes) -> str:
    """Each run of letters for itself, so that a part of a name has one surrogate wherever it stands; small words and the letter of O' or d' stay."""

    def of(m: re.Match) -> str:
        return m[0] if m[0] in _STAYS or len(m[0]) == 1 and s[m.end() : m.end() + 1] in ("'", "\u2019") else given_name(m[0], key)

    return _RUN.sub(of, s)


# ---------------------------------------------------------------- detection

_MARKED = re.compile(
    r"""(?P<email>[^\W_][\w.+%-]{0,63}@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}\b)
|(?P<secret>(?<![^\W_])[0-9a-f]{32,}(?![^\W_])|(?<![^\W_])[0-9A-F]{32,}(?![^\W_]))
|(?P<hexadecimal>(?<![^\W_:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![^\W_])|(?<![^\W_:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![^\W_])|(?<![^\W_:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![^\W_]))
|(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
|(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
|(?P<phone>\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?![^\W_])|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?(?!\d{1,3}(?:\.\d{1,3}){3})\d{2,4}){1,4}(?![^\W_])|(?<![^\W_])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![^\W_])|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]))
|(?P<card>(?<![\w-])\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}(?![\w-])|(?<![^\W_])\d{12,19}(?![^\W_]))""",
    re.X,
)
_ISSUED = re.compile(r"(?<![^\W_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}\b|(?:ghp_|gho_|github_pat_|sk-|xox[abprs]-)[0-9A-Za-z_-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{4,})")
#: A number with one of these words shortly before it is an account's or a person's.
_ACCOUNT = re.compile(r"(?i:\b(?:account|acct|routing|passport|konto|kontonummer|compte|cuenta|ssn|tax[ -]id|steuer-?id|dni|nif)\b)[^\w\n]{0,3}(?i:(?:number|no|nr|num|is|id|:|#)[^\w\n]{0,3}){0,2}(?P<n>(?:[A-Z]{1,2}(?=\d))?\d(?:[ -]?\d){5,17}(?:-?[A-Z])?)(?![^\W_])")
#: A number without a country's code is a telephone's if one of these words stands shortly before it.
_NATIONAL = re.compile(
    r"(?i:\b(?:tel|telefon|telephone|phone|mobile|mobil|handy|fax|cell|tél|téléphone|portable|móvil|teléfono)\b)[^\w\n]{0,3}(?i:(?:number|no|nr|num|is|ist|est|es)\b[^\w\n]{0,3}){0,2}"
    r"(?P<n>\d(?:[ )(/.-]{0,2}\d){5,14})(?![^\W_])"
)
_NATIONAL_CUES = ("tel", "phone", "mobil", "handy", "fax", "cell", "tél", "portable", "móvil")
_ACCOUNT_CUES = ("acc", "rout", "passp", "konto", "compte", "cuenta", "ssn", "tax", "steuer", "dni", "nif")
#: A dotted number after one of these is none of an address.
_VERSION = re.compile(r"(?i:\b(?:version|release|build|ver|rev|v)\.?[ \t]*)$")
_ISSUERS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "xox", "eyJ")
_ASSIGNED = re.compile(r"""(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b["']?\s{0,3}[:=]\s{0,3})(["']?)(?P<v>[^\s"']{8,})""")
#: In every match of ``_MARKED`` stands one of these: a digit of any script, an at-sign, or letters that a form without digits has.
_HINT = re.compile(r"[\d@]|[A-Fa-f]:[A-Fa-f:]|[A-Fa-f]{2}-[A-Fa-f]{2}[:-]|[a-f]{32}|[A-F]{32}")
#: In every match of ``_ASSIGNED``, case-folded, stands one of these.
_ASSIGNED_CUES = ("token", "secret", "passw", "pwd", "key")
#: A name can only follow one of these.
_CUES = (*TITLES, "y name is", "ein Name ist", "m'appelle", "m’appelle", "e llamo", "ame:")
_CAPITAL_CUES = tuple(map(str.upper, TITLES))
_MAKE = {"email": email, "secret": secret, "hexadecimal": hexadecimal, "iban": iban, "ipv4": ipv4, "ssn": number, "account": number, "phone": phone, "card": card, "person": person}


def _right(text: str, m: re.Match) -> bool:
    """A card's check digit is right, a telephone number has 7 to 15 digits, and an address is no version."""
    if m.lastgroup == "card":
        return luhn(digits_of(m[0]))
    if m.lastgroup == "phone":
        return 7 <= sum(map(str.isdecimal, m[0])) <= 15
    return m.lastgroup != "ipv4" or not _VERSION.search(text, max(0, m.start() - 12), m.start())


def marked(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of all matches of ``_MARKED``; only lines with a hint are searched, for no match goes over a line's end."""
    found, at = [], 0
    while m := _HINT.search(text, at):
        start, end = text.rfind("\n", at, m.start()) + 1, text.find("\n", m.start())
        start, end = max(start, at), len(text) if end < 0 else end
        found += [(*x.span(), x.lastgroup) for x in _MARKED.finditer(text, start, end) if _right(text, x)]
        at = end
    return found


def assigned(text: str) -> list[tuple[int, int]]:
    """Spans of the values of ``_ASSIGNED``, which may stand on a line after their key's."""
    if not (":" in text or "=" in text):
        return []
    folded = text.casefold()
    return [m.span("v") for m in _ASSIGNED.finditer(text)] if any(c in folded for c in _ASSIGNED_CUES) else []


def _whole(text: str, start: int) -> int:
    """Where the compound begins whose last part begins at ``start``."""
    while start > 1 and text[start - 1] in "-\u2010\u2011'\u2019" and text[start - 2].isalpha():
        start -= 1
        while start and (text[start - 1].isalpha() or "\u0300" <= text[start - 1] <= "\u036f"):
            start -= 1
    return start


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of every entity, in order, without overlaps."""
    found = marked(text) + [(*e, "secret") for e in assigned(text)]
    low = text.casefold()
    if any(c in low for c in _ACCOUNT_CUES):
        found += [(*m.span("n"), "account") for m in _ACCOUNT.finditer(text)]
    if any(c in low for c in _NATIONAL_CUES):
        found += [(*m.span("n"), "phone") for m in _NATIONAL.finditer(text)]
    if any(c in text for c in _ISSUERS):
        found += [(*m.span(), "secret") for m in _ISSUED.finditer(text)]
    if any(c in text for c in _CUES):
        found += [(*m.span("n"), "person") for m in _TITLE.finditer(text)]
    if any(c in text for c in _CAPITAL_CUES):
        found += [(*m.span("n"), "person") for m in _CAPITALS.finditer(text)]
    if any(n in text for n in _BY_NAME):
        found += [(_whole(text, m.start()), m.end(), "person") for m in _CALLED.finditer(text)]
    found.sort(key=lambda e: (e[0], -e[1]))
    out, end = [], 0
    for e in found:
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return sorted(out + more) if (more := mentions(text, out)) else out


#: Words of detected names that are no names: they are not looked for elsewhere in the text.
_NO_NAMES = frozenset("The An And Or Of In On At To For From By With Is Was He She It We You They Der Die Das Ein Eine Und Von Van Zu Im Am El La Los Las Le Les Un Una Une De Del Des Du Et Y".split()) | set(TITLES)
_WHOLE_WORD = re.compile(f"(?<![\\w\u0300-\u036f]){_LETTER}{{2,}}(?![\\w\u0300-\u036f])")


def mentions(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Every other whole-word mention of a part of a person in ``found``."""
    runs = {titled(m[0]) for start, end, kind in found if kind == "person" for m in _RUN.finditer(text, start, end)}
    parts = {w for w in runs if len(w) > 1 and not w[0].islower() and w not in _NO_NAMES}
    if not parts:
        return []
    out, k = [], 0
    for m in _WHOLE_WORD.finditer(text):
        if titled(m[0]) in parts:
            while k < len(found) and found[k][1] <= m.start():
                k += 1
            if k == len(found) or found[k][0] >= m.end():
                out.append((*m.span(), "person"))
    return out


@lru_cache(maxsize=1 << 12)
def _short_surrogate(entity: str, kind: str, key: bytes) -> str:
    return _MAKE[kind](entity, key)


def surrogate(entity: str, kind: str, key: bytes = KEY) -> str:
    return _short_surrogate(entity, kind, key) if len(entity) <= 128 else _MAKE[kind](entity, key)


def canonical(entity: str, kind: str) -> str:
    """What all writings of one entity share."""
    if kind in ("card", "account", "ssn"):
        return digits_of(entity)
    if kind == "phone":
        return "+" * (entity[0] == "+") + digits_of(entity)
    if kind == "iban":
        return "".join(digits_of(c) or c for c in entity if c.isalnum())
    if kind == "hexadecimal":
        low = entity.lower()
        return re.sub("[:-]", "", low) if re.fullmatch(r"(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}", low) else low
    if kind == "person":
        return _RUN.sub(lambda m: titled(m[0]), entity)
    return folded(entity) if kind == "email" else entity


def replace(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int, str, str]]]:
    """The text with surrogates, and (type, start, end, original, surrogate) of each entity, places in the original."""
    found = entities(text)
    if not found:
        return text, []
    parts, said, at, owners = [], [], 0, {}
    for start, end, kind in found:
        old = text[start:end]
        new = surrogate(old, kind, key)
        if owners.setdefault((kind, canonical(new, kind)), own := canonical(old, kind)) != own:
            raise ValueError(f"two entities of type {kind} got one surrogate")
        parts += [text[at:start], new]
        said.append((kind, start, end, old, new))
        at = end
    return "".join([*parts, text[at:]]), said


# ---------------------------------------------------------------- operators


def pseudonymise(docs: DataFrame, key: bytes = KEY, column: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``column``; all other columns as they are. No shuffle."""
    schema = docs.schema

    def run(batches):
        for b in slices(batches, column):
            texts = [None if t is None else replace(t, key)[0] for t in b.column(column).to_pylist()]
            i = b.schema.get_field_index(column)
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    return map_batches(docs, run, schema)


def detect(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities, and the entities' types in order, for every document."""

    def run(batches):
        for b in slices(batches, "text"):
            done = [(None, []) if t is None else replace(t, key) for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id").cast(pa.int64()), pa.array([t for t, _ in done], pa.string()), pa.array([len(e) for _, e in done], pa.int32()), pa.array([[x[0] for x in e] for _, e in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_entities", "types"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, text string, n_entities int, types array<string>")


def entity_table(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, type, original, surrogate, and the canonical forms of both, of every entity: confidential, for checks."""
    names = ["doc_id", "type", "original", "surrogate", "entity", "image"]

    def run(batches):
        for b in slices(batches, "text"):
            rows = [(i, e[0], e[3], e[4], canonical(e[3], e[0]), canonical(e[4], e[0])) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if t for e in replace(t, key)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k else pa.int64()) for k in range(len(names))], names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, ", ".join(f"{n} {'string' if k else 'long'}" for k, n in enumerate(names)))


def collisions(table: DataFrame) -> DataFrame:
    """Surrogates of one type that stand for several entities, and entities with several surrogates: none, if all is well."""
    pairs = table.select("type", "entity", "image").distinct()
    shared = pairs.groupBy("type", F.col("image").alias("value")).agg(F.count("*").alias("n")).where("n > 1").withColumn("what", F.lit("surrogate"))
    split = pairs.groupBy("type", F.col("entity").alias("value")).agg(F.count("*").alias("n")).where("n > 1").withColumn("what", F.lit("original"))
    return shared.unionByName(split)
