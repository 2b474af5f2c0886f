"""Hardware specifications out of free listing text.

Each function takes text that already went through ``to_half_width``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from souba import fixed_values as fv
from souba.functions.text import ANY_CASE, blank_to_null, first_match, let, literal_pattern, strip


def _any(text: Column, pattern: str, group: int = 1) -> Column:
    return first_match(text, pattern, group, ANY_CASE)


def brand(text: Column) -> Column:
    """H2 first word of the labelled maker field, else the first known brand."""
    field = F.get(F.split(strip(F.regexp_extract(text, ANY_CASE + fv.BRAND_FIELD, 1)), r"(?U)\s+"), 0)
    inline = _any(text, r"\b(" + literal_pattern(fv.BRANDS) + r")\b")
    return F.coalesce(blank_to_null(field), inline)


def model(text: Column) -> Column:
    """H3 labelled model number, else family name and the token after it."""
    field = blank_to_null(strip(F.regexp_extract(text, ANY_CASE + fv.MODEL_FIELD, 1)))
    family = r"(" + literal_pattern(fv.MODEL_FAMILIES) + r")\s+([\w\-]+)"
    words = F.regexp_replace(_any(text, family, 0), r"(?U)\s+", " ")
    return F.coalesce(field, words)


def operating_system(text: Column) -> Column:
    """H4"""
    return strip(_any(text, fv.OS_NAME))


def cpu(text: Column) -> Column:
    """H5 Japanese long form first, else the model-number form."""
    def form(pattern: str) -> Column:
        found = F.regexp_replace(strip(_any(text, pattern, 0)), "[,。　]+$", "")
        return let(found, lambda f: F.when(F.length(f) > 4, f))
    return F.coalesce(form(fv.CPU_JAPANESE), form(fv.CPU_LATIN))


def cpu_generation(text: Column) -> Column:
    """H6 named generation, else read off the CPU's model number."""
    low, high = fv.CPU_GENERATION_RANGE
    number = first_match(text, fv.GENERATION_FROM_NUMBER).try_cast("int")
    plausible = let(number, lambda n: F.when(n.between(low, high), n.cast("string")))
    return F.coalesce(
        first_match(text, fv.GENERATION_JAPANESE),
        _any(text, fv.GENERATION_ENGLISH),
        _any(text, fv.GENERATION_FROM_CPU),
        plausible,
    )


def memory(text: Column) -> Column:
    """H7 first pattern whose first hit is a size that exists."""
    sizes = F.create_map(*[F.lit(x) for gb in fv.MEMORY_SIZES_GB for x in (gb, f"{gb}GB")])
    return F.coalesce(*[F.try_element_at(sizes, _any(text, p).try_cast("int")) for p in fv.MEMORY])


def _capacity(text: Column, patterns: list[str]) -> Column:
    """Number and unit of the first hit, written together with the unit in capitals."""
    number_and_unit = r"(?isU)^.*?(\d+)\s*(GB|TB).*$"
    return F.coalesce(*[F.upper(F.regexp_replace(_any(text, p, 0), number_and_unit, "$1$2")) for p in patterns])


def ssd(text: Column) -> Column:
    """H8"""
    return _capacity(text, fv.SSD)


def hdd(text: Column) -> Column:
    """H8"""
    return _capacity(text, fv.HDD)


def _measure(text: Column, patterns: list[str], limits: tuple[float, float], unit: str) -> Column:
    def hit(pattern: str) -> Column:
        return let(_any(text, pattern).try_cast("double"), lambda value: F.when(
            value.between(*limits), F.concat(value.cast("string"), F.lit(unit))))
    return F.coalesce(*[hit(p) for p in patterns])


def display_size(text: Column) -> Column:
    """H9"""
    return _measure(text, fv.DISPLAY, fv.DISPLAY_RANGE_INCH, "インチ")


def weight(text: Column) -> Column:
    """H10"""
    return _measure(text, fv.WEIGHT, fv.WEIGHT_RANGE_KG, "kg")


def bluetooth(text: Column) -> Column:
    """H10"""
    return F.coalesce(
        F.concat(F.lit("Bluetooth "), _any(text, fv.BLUETOOTH_VERSION)),
        F.when(text.rlike(ANY_CASE + fv.BLUETOOTH), fv.PRESENT),
    )


def webcam(text: Column) -> Column:
    """H10"""
    named = [strip(_any(text, p, 0)) for p in fv.WEBCAM]
    return F.coalesce(*named, F.when(text.rlike(ANY_CASE + fv.WEBCAM_PRESENT), fv.PRESENT))


def usb_ports(text: Column) -> Column:
    """H10"""
    usb3 = F.concat(F.lit("USB3.0×"), _any(text, fv.USB_30))
    type_c = F.coalesce(
        F.concat(F.lit("USB3.1 Type-C×"), _any(text, fv.USB_31C)),
        F.when(text.rlike(ANY_CASE + fv.USB_C), "USB Type-C搭載"),
    )
    return blank_to_null(F.concat_ws(", ", usb3, type_c))


# --- H11 -------------------------------------------------------------------
def _words_in_order(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), " ")


def _compared_brands() -> Column:
    """The brands with, for each of their characters, the 64-bit mask of its places in the brand's words in order."""
    def told(rank: int, brand: str) -> str:
        text = " ".join(sorted(brand.split()))
        masks = {c: sum(1 << k for k, other in enumerate(text) if other == c) for c in text}
        pairs = ", ".join(f"'{c}', {mask}L" for c, mask in masks.items())
        return f"named_struct('rank', {-rank}, 'brand', '{brand}', 'n', {len(text)}, 'all', {(1 << len(text)) - 1}L, 'masks', map({pairs}))"
    return F.expr(f"array({', '.join(told(i, brand) for i, brand in enumerate(fv.BRANDS))})")


def _shared_in_order(chars: Column, brand: Column) -> Column:
    """Length of the longest common subsequence of a text's characters and a brand.

    One row of the usual table is a number whose zero bits mark where the length grows; a character changes the whole row
    by one addition.
    """
    places = F.transform(chars, lambda c: F.coalesce(F.try_element_at(brand["masks"], c), F.lit(0).cast("bigint")))
    row = F.aggregate(places, brand["all"], lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(brand["all"]))
    return brand["n"] - F.bit_count(row)


def known_brand(raw: Column) -> Column:
    """H11 exact part: the brand whose name equals the text but for case, else null."""
    names = ", ".join(f"'{b.lower()}', '{b}'" for b in fv.BRANDS)
    return F.try_element_at(F.expr(f"map({names})"), F.lower(raw))


def closest_brand(raw: Column) -> Column:
    """H11 fuzzy part: best brand at or above the cutoff (ties: first listed), else null.

    The score, 0 to 100, is twice the common subsequence over both lengths, words put in order first. A brand is
    compared only when its length and the characters it shares with the text leave the cutoff within reach.
    """
    def best(word: Column) -> Column:
        size = F.length(word)

        def scored(chars: Column) -> Column:
            shared = lambda s: F.least(F.size(F.filter(chars, lambda c: s["brand"].contains(c))), s["n"])
            near = F.filter(_compared_brands(), lambda s: 200.0 * shared(s) >= fv.BRAND_FUZZY_CUTOFF * (size + s["n"]))
            return F.transform(near, lambda s: F.struct((200.0 * _shared_in_order(chars, s) / (size + s["n"])).alias("score"), s["rank"], s["brand"]))
        return F.array_max(F.filter(let(F.split(word, ""), scored), lambda s: s["score"] >= fv.BRAND_FUZZY_CUTOFF))["brand"]

    return F.when(raw.isNotNull(), let(_words_in_order(raw), best))


def normalize_brand(raw: Column) -> Column:
    """H11 known brand, else the closest one, else the text as it is.

    The fuzzy branch runs only for rows the dictionary leaves over.
    """
    return let(raw, lambda r: F.coalesce(known_brand(r), closest_brand(r), r))


def with_brand(df: DataFrame, raw: str, brand: str = "brand") -> DataFrame:
    """H11 as a column of a table: what the dictionary leaves over is compared once per distinct text and joined back.

    Texts repeat far more than they differ; the join is left to the optimizer, which broadcasts the few or splits a
    text that many rows share. A null text has no brand.
    """
    named = df.withColumn("_known", known_brand(F.col(raw)))
    left_over = named.where(F.col("_known").isNull() & F.col(raw).isNotNull()).select(F.col(raw).alias("_raw")).distinct()
    closest = left_over.select("_raw", closest_brand(F.col("_raw")).alias("_closest"))
    asked = F.when(F.col("_known").isNull(), F.col(raw))
    joined = named.join(closest, asked == F.col("_raw"), "left")
    return joined.withColumn(brand, F.coalesce("_known", "_closest", F.col(raw))).drop("_known", "_raw", "_closest")


# --- H34 optional fields ----------------------------------------------------
def resolution(text: Column) -> Column:
    return F.coalesce(
        F.concat(_any(text, fv.RESOLUTION, 1), F.lit("x"), _any(text, fv.RESOLUTION, 2)),
        F.when(text.rlike(ANY_CASE + fv.RESOLUTION_FULL_HD), "1920x1080"),
        F.when(text.rlike(ANY_CASE + fv.RESOLUTION_HD), "1366x768"),
    )


def panel_type(text: Column) -> Column:
    return F.when(text.rlike(ANY_CASE + fv.PANEL_IPS), "IPS").when(text.rlike(ANY_CASE + fv.PANEL_TN), "TN")


def wireless(text: Column) -> Column:
    return F.coalesce(*[_any(text, p) for p in fv.WIRELESS],
                      F.when(text.rlike(ANY_CASE + fv.WIRELESS_PRESENT), fv.PRESENT))


def optical_drive(text: Column) -> Column:
    return (
        F.when(text.rlike(ANY_CASE + fv.OPTICAL_NONE), fv.NONE_WORD)
        .otherwise(F.coalesce(
            _any(text, fv.OPTICAL_KIND),
            F.when(text.rlike(ANY_CASE + fv.OPTICAL_DVD_NONE), fv.NONE_WORD)))
    )


def warranty(text: Column) -> Column:
    return F.coalesce(*[strip(_any(text, p)) for p in fv.WARRANTY])


def office(text: Column) -> Column:
    return (
        F.when(text.rlike(ANY_CASE + fv.OFFICE_NONE), fv.NONE_WORD)
        .otherwise(F.coalesce(*[strip(_any(text, p, 0)) for p in fv.OFFICE]))
    )


def tenkey(text: Column) -> Column:
    return F.coalesce(text.rlike(ANY_CASE + fv.TENKEY), F.lit(False))


OPTIONAL_FIELDS = {
    "resolution": resolution, "panel_type": panel_type, "wireless": wireless,
    "tenkey": tenkey, "optical_drive": optical_drive, "office": office, "warranty": warranty,
}
FIELDS = {
    "brand": lambda t: normalize_brand(brand(t)),
    "model": model, "os": operating_system, "cpu": cpu, "cpu_gen": cpu_generation,
    "memory": memory, "ssd": ssd, "hdd": hdd, "display_size": display_size,
    "weight": weight, "bluetooth": bluetooth, "webcam": webcam, "usb_ports": usb_ports,
}
