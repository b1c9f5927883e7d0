"""Plain Python reading of one timestamp text, used to test the column version."""

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

WHITE = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
MONTHS = {}
for number, names in enumerate(
    ["jan january januari januar", "feb february februari februar", "mar march maart mrt märz mär maerz", "apr april", "may mei mai",
     "jun june juni", "jul july juli", "aug august augustus", "sep sept september", "oct october oktober okt", "nov november", "dec december dezember dez"], 1):
    for name in names.split():
        MONTHS[name] = number
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
EPOCH = datetime(1970, 1, 1)
LOW, HIGH = 0, 4102444800  # 1970 to 2100, in seconds
ZONE = r"(?:\s*(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?(?:\[([A-Za-z_/+\-0-9]+)\])?"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"


def micros(day, h, m, s, frac=""):
    if not (h < 24 and m < 60 and s < 60):
        return None
    return (datetime(day.year, day.month, day.day) - EPOCH).days * 86_400_000_000 + ((h * 60 + m) * 60 + s) * 1_000_000 + int((frac or "")[:6].ljust(6, "0"))


def on(y, m, d):
    try:
        return date(y, m, d)
    except ValueError:
        return None


def zoned(local, zone):
    """UTC instants whose wall clock in zone shows local (micros)."""
    tz, found = ZoneInfo(zone), set()
    for fold in (0, 1):
        wall = EPOCH + timedelta(microseconds=local)
        utc = wall.replace(tzinfo=tz, fold=fold).astimezone(timezone.utc)
        if utc.astimezone(tz).replace(tzinfo=None) == wall:
            found.add(local - int(utc.astimezone(tz).utcoffset().total_seconds()) * 1_000_000)
    return found


def settle(local, mark, region, zone):
    if local is None:
        return set()
    if mark and mark[0] in "+-":
        digits = mark[1:].replace(":", "").ljust(4, "0")
        off = (int(digits[:2]) * 60 + int(digits[2:])) * 60_000_000 * (-1 if mark[0] == "-" else 1)
        return {local - off}
    if mark and mark.upper() in ("Z", "UTC", "GMT") and not (mark.upper() == "GMT" and zone == "Europe/London"):
        return {local}
    if not zone:
        return set()
    if mark:
        tz = ZoneInfo(zone)
        return {u for u in zoned(local, zone) if (EPOCH + timedelta(microseconds=u)).replace(tzinfo=timezone.utc).astimezone(tz).tzname() == mark.upper()}
    return zoned(local, zone)


def read(text, zone=None, order=None):
    """All instants the text may denote under the producer's zone and date order."""
    if text is None:
        return set()
    s = text.strip(WHITE)
    if m := re.fullmatch(rf"(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{CLOCK}(?:\s*([AaPp][Mm]))?{ZONE})?", s):
        y, mo, d, h, mi, sec, frac, half, mark, region = m.groups()
        day, h = on(int(y), int(mo), int(d)), int(h or 0)
        if half:
            if not 1 <= h <= 12:
                return set()
            h = h % 12 + 12 * (half.upper() == "PM")
        return settle(day and micros(day, h, int(mi or 0), int(sec or 0), frac), mark, region, zone)
    if m := re.fullmatch(rf"(\d{{4}})-(\d{{3}})T{CLOCK}{ZONE}", s):
        y, n, h, mi, sec, frac, mark, region = m.groups()
        day = date(int(y), 1, 1) + timedelta(days=int(n) - 1) if int(y) else None
        return settle(micros(day, int(h), int(mi), int(sec or 0), frac) if day and day.year == int(y) else None, mark, region, zone)
    if m := re.fullmatch(rf"(\d{{4}})-W(\d{{2}})-(\d)T{CLOCK}{ZONE}", s):
        y, w, n, h, mi, sec, frac, mark, region = m.groups()
        try:
            day = date.fromisocalendar(int(y), int(w), int(n))
        except ValueError:
            return set()
        return settle(micros(day, int(h), int(mi), int(sec or 0), frac), mark, region, zone)
    if m := re.fullmatch(rf"(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}}){ZONE}", s):
        y, mo, d, h, mi, sec, mark, region = m.groups()
        day = on(int(y), int(mo), int(d))
        return settle(day and micros(day, int(h), int(mi), int(sec)), mark, region, zone)
    if m := re.fullmatch(r"(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2})?)?", s):
        if len(s) in (8, 12, 14) and "1970" <= s[:4] < "2100":
            y, mo, d, h, mi, sec = m.groups()
            day = on(int(y), int(mo), int(d))
            return settle(day and micros(day, int(h or 0), int(mi or 0), int(sec or 0)), None, None, zone)
    if m := re.fullmatch(r"(\d{9,19})(?:\.(\d{1,9}))?", s):
        whole, frac = m.groups()
        found = set()
        for power in (0, 3, 6, 9):
            if frac and power:
                continue
            scaled = int(whole) * 10**9 // 10**power
            if 10**8 * 10**9 <= scaled < HIGH * 10**9:
                found.add(scaled // 1000 + int((frac or "")[:6].ljust(6, "0")))
        return found
    if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?: (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([AaPp][Mm]))?)?", s):
        a, b, y, h, mi, sec, half = m.groups()
        if not zone or order not in ("DMY", "MDY"):
            return set()
        d, mo = (a, b) if order == "DMY" else (b, a)
        h = int(h or 0)
        if half:
            if not 1 <= h <= 12:
                return set()
            h = h % 12 + 12 * (half.upper() == "PM")
        day = on(int(y) + 2000 * (len(y) == 2), int(mo), int(d))
        return settle(day and micros(day, h, int(mi or 0), int(sec or 0)), None, None, zone)
    if m := re.fullmatch(rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?: {CLOCK})?", s):
        d, mo, y, h, mi, sec, frac = m.groups()
        day = on(int(y), int(mo), int(d))
        return settle(day and micros(day, int(h or 0), int(mi or 0), int(sec or 0), frac), None, None, zone)
    if m := re.fullmatch(rf"(?:([A-Za-z]{{3}}), )?(\d{{1,2}})[- ]([^\W\d_]{{3,9}})\.?[- ](\d{{4}}) {CLOCK}{ZONE}", s):
        week, d, mo, y, h, mi, sec, frac, mark, region = m.groups()
        day = on(int(y), MONTHS.get(mo.lower(), 0), int(d))
        if week and day and DAYS[day.weekday()] != week.lower():
            return set()
        return settle(day and micros(day, int(h), int(mi), int(sec or 0), frac), mark, region, zone)
    if m := re.fullmatch(rf"([A-Za-z]{{3,9}}) (\d{{1,2}}), (\d{{4}}) {CLOCK}{ZONE}", s):
        mo, d, y, h, mi, sec, frac, mark, region = m.groups()
        day = on(int(y), MONTHS.get(mo.lower(), 0), int(d))
        return settle(day and micros(day, int(h), int(mi), int(sec or 0), frac), mark, region, zone)
    return set()
