"""What column names say: meaning, kind of values and unit. Works on schemas only."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Words that stand for a canonical name, in order of precedence.
MEANINGS: dict[str, tuple[str, ...]] = {
    "temperature": ("temperature", "temp", "tmp", "温度", "料温", "炉温"),
    "pressure": ("pressure", "press", "prs", "压力", "压强"),
    "vibration": ("vibration", "vib", "振动", "震动"),
    "flow_rate": ("flowrate", "flow", "flux", "rate", "流量", "流速"),
    "timestamp": ("timestamp", "datetime", "time", "ts", "时间", "时刻", "采样时间"),
    "device_id": ("deviceid", "device", "equipment", "equipid", "channelid", "pointid", "设备", "装置", "点位"),
    "state": ("state", "status", "mode", "phase", "flag", "状态", "工况"),
    "command": ("command", "control", "cmd", "setpoint", "instruction", "指令", "控制", "设定"),
    "alarm": ("alarm", "alert", "warn", "fault", "trip", "告警", "报警", "故障"),
    "current": ("current", "amp", "amps", "电流"),
    "voltage": ("voltage", "volt", "电压"),
    "power": ("power", "kw", "watt", "功率"),
    "energy": ("energy", "kwh", "wh", "电量", "能耗", "能量"),
    "frequency": ("frequency", "freq", "hz", "频率"),
    "speed": ("speed", "rpm", "velocity", "转速", "速度"),
    "humidity": ("humidity", "humid", "湿度"),
    "level": ("level", "liquidlevel", "液位", "料位"),
    "position": ("position", "pos", "loc", "位置"),
    "opening": ("opening", "openratio", "开度"),
    "concentration": ("concentration", "conc", "浓度"),
    "count": ("count", "qty", "num", "数量", "计数"),
    "batch_id": ("batch", "lot", "批次"),
    "order_id": ("order", "工单", "订单"),
    "product_id": ("product", "material", "产品", "物料"),
    "operator_id": ("operator", "worker", "操作员"),
}


@dataclass(frozen=True)
class Unit:
    """value * scale + offset is the value in the domain's base unit. A name has the unit if its canonical name holds
    the domain and its plain form one of the words."""

    name: str
    domain: str
    words: tuple[str, ...]
    scale: float = 1.0
    offset: float = 0.0


# Units in the order in which they are looked for.
UNITS = (
    Unit("°C", "temperature", ("degc", "celsius", "tempc", "℃"), 1.0, 273.15),
    Unit("°F", "temperature", ("degf", "fahrenheit", "tempf", "华氏"), 1 / 1.8, 273.15 - 32 / 1.8),
    Unit("K", "temperature", ("kelvin", "tempk")),
    Unit("MPa", "pressure", ("mpa",), 1e6),
    Unit("kPa", "pressure", ("kpa",), 1e3),
    Unit("bar", "pressure", ("bar",), 1e5),
    Unit("Pa", "pressure", ("pressurepa", "unitpa")),
    Unit("L/min", "flow", ("lpm", "lmin", "lpermin"), 1 / 60000),
    Unit("m3/h", "flow", ("m3h", "m3hour"), 1 / 3600),
    Unit("m3/s", "flow", ("m3s", "m3sec")),
    Unit("mm/s", "vibration", ("mms", "mms2", "mmsrms")),
    Unit("µm/s", "vibration", ("ums", "ums2"), 1e-3),
    Unit("mA", "current", ("ma",), 1e-3),
    Unit("A", "current", ("current", "amp", "amps", "ampere")),
    Unit("mV", "voltage", ("mv",), 1e-3),
    Unit("V", "voltage", ("voltage", "volt")),
    Unit("kW", "power", ("kw",), 1e3),
    Unit("W", "power", ("watt", "power")),
    Unit("kWh", "energy", ("kwh",), 1e3),
    Unit("Wh", "energy", ("energy",)),
    Unit("kHz", "frequency", ("khz",), 1e3),
    Unit("Hz", "frequency", ("freq", "frequency", "hz")),
    Unit("rps", "speed", ("rps",)),
    Unit("rpm", "speed", ("rpm", "speed"), 1 / 60),
)
PERCENT = Unit("%", "percentage", ("percent", "pct"))
_PERCENT_NAMES = ("humidity", "level", "opening", "percentage")
STATE_WORDS = ("state", "status", "mode", "phase", "flag", "switch")
EVENT_WORDS = ("event", "command", "alarm", "action", "fault", "trip", "code")
# How well kinds of values go together; both orders count.
KINDS_TOGETHER = {
    ("continuous", "continuous"): 1.0, ("state", "state"): 1.0, ("event", "event"): 1.0, ("text", "text"): 0.92,
    ("state", "text"): 0.72, ("event", "text"): 0.66, ("event", "state"): 0.35,
}

# How alike names are of which one holds the other; the shares of words and letter pairs; from where on a
# name binds a column, or stands for a key; how well unknown, half known and convertible units go together; the least
# score of kinds under one name; the parts of a binding's score; all scores of a column bound to none.
CONTAINED = 0.86
WORD_SHARE, PAIR_SHARE = 0.7, 0.3
LEAST_TO_BIND, LEAST_FOR_KEY = 0.68, 0.84
BOTH_UNKNOWN, ONE_UNKNOWN, CONVERTIBLE = 0.72, 0.82, 0.94
SAME_NAME_KIND = 0.72
NAME_PART, KIND_PART, UNIT_PART = 0.6, 0.25, 0.15
UNBOUND = 0.55


def plain(name: str) -> str:
    return "".join(c.lower() for c in name if c.isalnum())


def canonical(name: str) -> str:
    """The first meaning one of whose words the name holds, else its plain form."""
    p = plain(name)
    return next((m for m, words in MEANINGS.items() if any(w in p for w in words)), p)


def words_of(name: str) -> set[str]:
    """Parts at separators, at a capital between small letters and between digits and others; each as its meaning."""
    marked = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])", " ", name)
    parts = [x.lower() for x in re.split(r"[^\w%]+|_", marked) if x] or [plain(name)]
    return {w for x in parts for w in next((m.split("_") for m, words in MEANINGS.items() if x in words), [x])}


def alike(a: str, b: str) -> float:
    """0 to 1: equal, one within the other, or by shared words and letter pairs."""
    if a == b:
        return 1.0
    if a in b or b in a:
        return CONTAINED
    x, y = words_of(a), words_of(b)
    words = len(x & y) / len(x | y) if x and y else 0.0
    p, q = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (plain(a), plain(b)))
    pairs = len(p & q) / len(p | q) if p and q else 0.0
    return max(words, WORD_SHARE * words + PAIR_SHARE * pairs)


def value_kind(name: str, numeric: bool) -> str:
    p = plain(name)
    if any(w in p for w in STATE_WORDS) or not numeric and "step" in p:
        return "state"
    if any(w in p for w in EVENT_WORDS):
        return "event"
    return "continuous" if numeric else "text"


def unit_of(name: str) -> Unit | None:
    c, p = canonical(name), plain(name)
    for u in UNITS:
        if u.domain in c and (any(w in p for w in u.words) or u.name == "°C" and "℃" in name):
            if not (u.name == "A" and "alarm" in p):
                return u
    if any(w in c for w in _PERCENT_NAMES) and (any(w in p for w in PERCENT.words) or "%" in name):
        return PERCENT
    return None


def kinds_score(a: str, b: str) -> float:
    return KINDS_TOGETHER.get(tuple(sorted((a, b))), 0.0)


def units_score(a: Unit | None, b: Unit | None, kind_a: str, kind_b: str) -> float:
    if kind_a != "continuous" or kind_b != "continuous":
        return 1.0
    if a is None or b is None:
        return BOTH_UNKNOWN if a is b else ONE_UNKNOWN
    return 1.0 if a == b else CONVERTIBLE if a.domain == b.domain else 0.0


@dataclass(frozen=True)
class Binding:
    """A secondary column: the primary column it is merged into, or none for a new column, and how sure that is."""

    column: str
    into: str | None
    semantic: float
    kind_score: float
    unit_score: float


def bind(column: str, numeric: bool, primary: dict[str, bool], by_meaning: bool = True, by_kind: bool = True) -> Binding:
    """primary: its columns, and whether they are numeric. The same name wins if kind and unit allow it; else the best
    name from 0.68 on, whose combined score then is the semantic one."""
    kind, unit = value_kind(column, numeric), unit_of(column)

    def scores(p: str) -> tuple[float, float]:
        k = value_kind(p, primary[p])
        return kinds_score(k, kind), units_score(unit_of(p), unit, k, kind)

    if column in primary:
        k, u = scores(column)
        if (k > 0 or not by_kind) and u > 0:
            return Binding(column, column, 1.0, max(k, SAME_NAME_KIND), u)
    best: Binding | None = None
    for p in primary if by_meaning else ():
        s = alike(canonical(p), canonical(column))
        k, u = scores(p)
        if s >= LEAST_TO_BIND and (k > 0 or not by_kind) and u > 0:
            total = NAME_PART * s + KIND_PART * k + UNIT_PART * u
            if best is None or total > best.semantic:
                best = Binding(column, p, total, k, u)
    return best or Binding(column, None, UNBOUND, UNBOUND, UNBOUND)


def counterpart(name: str, columns: list[str]) -> str | None:
    """The column of another table that means the same: equal plain names, else the best from 0.84 on."""
    for c in columns:
        if plain(c) == plain(name):
            return c
    scored = [(alike(canonical(name), canonical(c)), c) for c in columns]
    top = max((s for s, _ in scored), default=0.0)
    return next((c for s, c in scored if s == top), None) if top >= LEAST_FOR_KEY else None
