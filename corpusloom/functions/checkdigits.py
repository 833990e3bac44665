"""Check-digit rules of identifiers; each takes the bare characters and says whether they are valid."""

from __future__ import annotations

import hashlib
from datetime import date

_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_B32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _weighted(digits: str, weights) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights))


def credit_card(number: str) -> bool:
    """Issuer's range for the length, and Luhn."""
    n, two, three, four = len(number), int(number[:2]), int(number[:3]), int(number[:4])
    known = (
        (number[0] == "4" and n in (13, 16))
        or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or four == 6011 or two == 65 or two == 35))
        or (n == 15 and (two in (34, 37) or four in (2131, 1800)))
        or (n == 14 and (300 <= three <= 305 or two in (36, 38)))
    )
    return known and luhn(number)


def bitcoin(address: str) -> bool:
    if address.startswith("bc1"):
        data = [_B32.find(c) for c in address[3:]]
        if min(data) < 0:
            return False
        check = 1
        for v in [3, 3, 0, 2, 3, *data]:
            top = check >> 25
            check = (check & 0x1FFFFFF) << 5 ^ v
            for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
                check ^= g if top >> i & 1 else 0
        return check in (1, 0x2BC830A3)
    n = 0
    for c in address:
        if c not in _B58:
            return False
        n = n * 58 + _B58.index(c)
    if n >= 1 << 200:
        return False
    raw = n.to_bytes(25, "big")
    return raw[0] in (0, 5) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def dni(value: str) -> bool:
    return len(value) == 9 and value[:8].isdigit() and _DNI[int(value[:8]) % 23] == value[8]


def nie(value: str) -> bool:
    return len(value) == 9 and dni(str("XYZ".index(value[0])) + value[1:])


def ccc(value: str) -> bool:
    if len(value) != 20:
        return False
    weights = [1, 2, 4, 8, 5, 10, 9, 7, 3, 6]
    digit = lambda s: {10: 1, 11: 0}.get(11 - _weighted(s, weights) % 11, 11 - _weighted(s, weights) % 11)
    return digit("00" + value[:8]) == int(value[8]) and digit(value[10:]) == int(value[9])


def _day(year: int, month: int, day: int) -> bool:
    try:
        return bool(date(year, month, day))
    except ValueError:
        return False


def curp(value: str) -> bool:
    alphabet = "0123456789ABCDEFGHIJKLMN&OPQRSTUVWXYZ"
    century = 1900 if value[16].isdigit() else 2000
    if not _day(century + int(value[4:6]), int(value[6:8]), int(value[8:10])):
        return False
    total = sum(alphabet.index(c) * (18 - i) for i, c in enumerate(value[:17]))
    return (10 - total % 10) % 10 == int(value[17])


def nif(value: str) -> bool:
    value = value.removeprefix("PT")
    if len(value) != 9 or value[0] == "0":
        return False
    return (11 - _weighted(value, range(9, 1, -1)) % 11) % 11 % 10 == int(value[8])


def citizen_card(value: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(value)):
        n = int(c, 36) * (1 + i % 2)
        total += n - 9 * (n > 9 and i % 2)
    return len(value) == 12 and total % 10 == 0


def cpf(value: str) -> bool:
    if len(value) != 11 or value == value[0] * 11:
        return False
    one = (11 - _weighted(value[:9], range(10, 1, -1)) % 11) % 11 % 10
    two = (11 - _weighted(value[:10], range(11, 1, -1)) % 11) % 11 % 10
    return value[9:] == f"{one}{two}"


def abn(value: str) -> bool:
    if len(value) != 11:
        return False
    return (_weighted(value, [10, *range(1, 20, 2)]) - 10) % 89 == 0


def tfn(value: str) -> bool:
    weights = {8: [10, 7, 8, 4, 6, 3, 5, 1], 9: [1, 4, 3, 7, 5, 8, 6, 9, 10]}.get(len(value))
    return bool(weights) and _weighted(value, weights) % 11 == 0


def sin(value: str) -> bool:
    return len(value) == 9 and value[0] not in "08" and luhn(value)



def _dihedral(a: int, b: int) -> int:
    """Product in the group of a pentagon's ten symmetries."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def verhoeff(digits: str) -> bool:
    swap = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    check = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        for _ in range(i % 8):
            n = swap[n]
        check = _dihedral(check, n)
    return check == 0


def aadhaar(value: str) -> bool:
    return len(value) == 12 and value[0] not in "01" and value != value[::-1] and verhoeff(value)


def resident_card(value: str) -> bool:
    if not _day(int(value[6:10]), int(value[10:12]), int(value[12:14])):
        return False
    total = sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(value[:17]))
    return "10X98765432"[total % 11] == value[17]


def ssn(value: str) -> bool:
    """Area, group and serial number that the administration gives out: none is zero, areas aren't 666 or above 899."""
    digits = "".join(c for c in value if c.isdigit())
    area, group, serial = digits[:3], digits[3:5], digits[5:]
    return len(digits) == 9 and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
