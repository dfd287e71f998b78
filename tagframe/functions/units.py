"""Unit conversion in columns: factors are a literal map, so a conversion stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each quantity its units as (name, symbols, scale, offset); base = value * scale + offset. The first unit of scale 1 and offset 0 named in BASE is the base.
UNITS = {
    "temperature": [("fahrenheit", "°F", 5.0 / 9.0, -32.0 * 5.0 / 9.0), ("celsius", "°C", 1.0, 0.0), ("kelvin", "K", 1.0, -273.15)],
    "length": [("meter", "m", 1.0, 0.0), ("kilometer", "km", 1000.0, 0.0), ("centimeter", "cm", 0.01, 0.0), ("millimeter", "mm", 0.001, 0.0), ("foot", "ft", 0.3048, 0.0), ("inch", "in", 0.0254, 0.0), ("mile", "mile", 1609.344, 0.0), ("yard", "yd", 0.9144, 0.0)],
    "pressure": [("pascal", "Pa", 1.0, 0.0), ("kilopascal", "kPa", 1000.0, 0.0), ("bar", "bar", 100000.0, 0.0), ("millibar", "mbar", 100.0, 0.0), ("pounds_per_square_inch", "psi", 6894.757, 0.0), ("inches_of_water", "in/wc inH₂O", 248.84, 0.0), ("inches_of_mercury", "inHg", 3386.389, 0.0), ("atmosphere", "atm", 101325.0, 0.0), ("hectopascal", "hPa", 100.0, 0.0)],
    "energy": [("joule", "J", 1.0, 0.0), ("kilojoule", "kJ", 1000.0, 0.0), ("megajoule", "MJ", 1e6, 0.0), ("kilowatt_hour", "kWh", 3.6e6, 0.0), ("watt_hour", "Wh", 3600.0, 0.0), ("btu", "BTU", 1055.06, 0.0), ("megabtu", "MBTU MMBTU", 1.05506e9, 0.0), ("therm", "therm", 1.05506e8, 0.0), ("tons_refrigeration_hour", "tonrefh", 1.2661e7, 0.0), ("kilobtu", "kBTU", 1.05506e6, 0.0)],
    "power": [("watt", "W", 1.0, 0.0), ("kilowatt", "kW", 1000.0, 0.0), ("megawatt", "MW", 1e6, 0.0), ("horsepower", "hp", 745.7, 0.0), ("btus_per_hour", "BTU/h", 0.29307, 0.0), ("tons_refrigeration", "tonref", 3516.85, 0.0), ("kilobtus_per_hour", "kBTU/h", 293.07, 0.0)],
    "volume": [("cubic_meter", "m³", 1.0, 0.0), ("liter", "L", 0.001, 0.0), ("milliliter", "mL", 1e-6, 0.0), ("gallon", "gal", 0.003785, 0.0), ("quart", "qt", 0.000946353, 0.0), ("pint", "pt", 0.000473176, 0.0), ("fluid_ounce", "fl_oz", 2.957e-5, 0.0), ("cubic_foot", "ft³", 0.028317, 0.0), ("imperial_gallon", "galUK", 0.004546, 0.0)],
    "volumetric flow": [("cubic_meters_per_second", "m³/s", 1.0, 0.0), ("liters_per_second", "L/s", 0.001, 0.0), ("liters_per_minute", "L/min", 1.667e-5, 0.0), ("cubic_feet_per_minute", "cfm", 0.000472, 0.0), ("gallons_per_minute", "gal/min", 6.309e-5, 0.0), ("cubic_meters_per_hour", "m³/h", 2.778e-4, 0.0), ("liters_per_hour", "L/h", 2.778e-7, 0.0)],
    "area": [("square_meter", "m²", 1.0, 0.0), ("square_foot", "ft²", 0.0929, 0.0), ("square_kilometer", "km²", 1e6, 0.0), ("square_mile", "mile²", 2.59e6, 0.0), ("acre", "acre", 4046.86, 0.0), ("square_centimeter", "cm²", 1e-4, 0.0), ("square_inch", "in²", 6.452e-4, 0.0)],
    "mass": [("kilogram", "kg", 1.0, 0.0), ("gram", "g", 0.001, 0.0), ("milligram", "mg", 1e-6, 0.0), ("metric_ton", "ton", 1000.0, 0.0), ("pound", "lb", 0.4536, 0.0), ("ounce", "oz", 0.02835, 0.0), ("short_ton", "t", 907.185, 0.0)],
    "time": [("second", "s sec", 1.0, 0.0), ("millisecond", "ms", 0.001, 0.0), ("minute", "min", 60.0, 0.0), ("hour", "h hr", 3600.0, 0.0), ("day", "day", 86400.0, 0.0), ("week", "wk", 604800.0, 0.0), ("julian_month", "mo", 2629800.0, 0.0), ("year", "yr", 31557600.0, 0.0)],
    "electric current": [("ampere", "A", 1.0, 0.0), ("milliampere", "mA", 0.001, 0.0)],
    "electric potential": [("volt", "Volt V", 1.0, 0.0), ("millivolt", "mV", 0.001, 0.0), ("kilovolt", "kV", 1000.0, 0.0), ("megavolt", "MV", 1e6, 0.0)],
    "frequency": [("hertz", "Hz", 1.0, 0.0), ("kilohertz", "kHz", 1000.0, 0.0), ("megahertz", "MHz", 1e6, 0.0), ("per_minute", "/min", 1.0 / 60.0, 0.0), ("per_hour", "/h", 1.0 / 3600.0, 0.0), ("per_second", "/s", 1.0, 0.0)],
    "illuminance": [("lux", "lx", 1.0, 0.0), ("footcandle", "fc", 10.764, 0.0), ("phot", "phot", 10000.0, 0.0)],
    "luminous flux": [("lumen", "lm", 1.0, 0.0)],
}
BASE = {"temperature": "celsius"} | {q: u[0][0] for q, u in UNITS.items() if q != "temperature"}
BY_NAME = {key: (q, name, scale, offset) for q, units in UNITS.items() for name, symbols, scale, offset in units for key in (name, *symbols.split())}


class UnknownUnit(ValueError):
    pass


class IncompatibleUnits(ValueError):
    pass


def factors(unit: str) -> tuple[str, str, float, float]:
    if unit not in BY_NAME:
        raise UnknownUnit(unit)
    return BY_NAME[unit]


def convert(value: Column, source: str, target: str) -> Column:
    """Between two units known when the plan is made; UnknownUnit or IncompatibleUnits otherwise."""
    (q, _, scale, offset), (q2, _, scale2, offset2) = factors(source), factors(target)
    if q != q2:
        raise IncompatibleUnits(f"{source} and {target}")
    return (value * F.lit(scale) + F.lit(offset) - F.lit(offset2)) / F.lit(scale2)


def _lookup(column: Column, at: int) -> Column:
    pairs = [F.lit(x) for k, v in BY_NAME.items() for x in (k, v[at])]
    return F.create_map(*pairs)[column]


def try_convert(value: Column, source: Column, target: Column) -> Column:
    """Between units in columns; null where they are unknown or incompatible."""
    out = (value * _lookup(source, 2) + _lookup(source, 3) - _lookup(target, 3)) / _lookup(target, 2)
    return F.when(compatible(source, target), out)


def quantity(unit: Column) -> Column:
    return _lookup(unit, 0)


def unit_name(unit: Column) -> Column:
    return _lookup(unit, 1)


def base_unit(q: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])[q]


def compatible(a: Column, b: Column) -> Column:
    return F.coalesce(quantity(a) == quantity(b), F.lit(False))


def convert_number(v: Column, target: str) -> Column:
    """A Number value in another unit; null for one without a unit or of another quantity."""
    from .kinds import number

    out = try_convert(v.num, v.unit, F.lit(target))
    return F.when((v.kind == "number") & out.isNotNull(), number(out, factors(target)[1]))
