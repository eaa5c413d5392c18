"""Numbers in words, English and Russian (nominative), for up to nine digits."""

from __future__ import annotations

# Number words.
EN_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_SCALES = ((1_000_000, "million"), (1_000, "thousand"))
RU_SMALL = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
RU_TENS = "- - двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
RU_HUNDREDS = "- сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
RU_SCALES = ((1_000_000, ("миллион", "миллиона", "миллионов"), False), (1_000, ("тысяча", "тысячи", "тысяч"), True))
RU_PARTS = {1: ("десятая", "десятых"), 2: ("сотая", "сотых"), 3: ("тысячная", "тысячных"), 4: ("десятитысячная", "десятитысячных")}


def _en_below_hundred(n: int) -> str:
    if n < 20:
        return EN_SMALL[n]
    tens, ones = divmod(n, 10)
    return EN_TENS[tens] + (f"-{EN_SMALL[ones]}" if ones else "")


def _en_below_thousand(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    if not hundreds:
        return _en_below_hundred(rest)
    return f"{EN_SMALL[hundreds]} hundred" + (f" and {_en_below_hundred(rest)}" if rest else "")


def english(n: int) -> str:
    """The last group is joined by "and" if it is below a hundred, by a comma otherwise."""
    groups = []
    rest = n
    for size, name in EN_SCALES:
        count, rest = divmod(rest, size)
        if count:
            groups.append(f"{_en_below_thousand(count)} {name}")
    if not groups:
        return _en_below_thousand(n)
    out = ", ".join(groups)
    if rest:
        out += (" and " if rest < 100 else ", ") + _en_below_thousand(rest)
    return out


def english_year(n: int) -> str:
    century, year = divmod(n, 100)
    if century % 10 == 0 and year < 10:
        return english(n)
    tail = "hundred" if not year else f"oh-{EN_SMALL[year]}" if year < 10 else _en_below_hundred(year)
    return f"{_en_below_hundred(century)} {tail}"


def _ru_form(n: int, forms: tuple[str, str, str]) -> str:
    if n % 100 in range(11, 15):
        return forms[2]
    return forms[0] if n % 10 == 1 else forms[1] if n % 10 in (2, 3, 4) else forms[2]


def _ru_below_thousand(n: int, feminine: bool) -> list[str]:
    out = []
    hundreds, rest = divmod(n, 100)
    if hundreds:
        out.append(RU_HUNDREDS[hundreds])
    if rest >= 20:
        out.append(RU_TENS[rest // 10])
        rest %= 10
    if rest:
        out.append({1: "одна", 2: "две"}.get(rest, RU_SMALL[rest]) if feminine else RU_SMALL[rest])
    return out


def russian(n: int, feminine: bool = False) -> str:
    if not n:
        return RU_SMALL[0]
    words, rest = [], n
    for size, forms, she in RU_SCALES:
        count, rest = divmod(rest, size)
        if count:
            words += [*_ru_below_thousand(count, she), _ru_form(count, forms)]
    return " ".join(words + _ru_below_thousand(rest, feminine))


def decimal(whole: str, fraction: str, language: str) -> str:
    """A decimal number; zeros that end the fraction are not spoken."""
    n, fraction = int(whole), fraction.rstrip("0")
    if language == "en":
        return f"{english(n)} point {' '.join(EN_SMALL[int(d)] for d in fraction)}"
    part = int(fraction)
    one = lambda x: x % 10 == 1 and x % 100 != 11
    return f"{russian(n, True)} {'целая' if one(n) else 'целых'} {russian(part, True)} {RU_PARTS[len(fraction)][0 if one(part) else 1]}"


def cardinal(n: int, language: str) -> str:
    return english(n) if language == "en" else russian(n)
