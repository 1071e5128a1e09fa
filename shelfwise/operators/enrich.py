"""From product texts and pages to structured attributes, as rules over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.regions import region_text
from shelfwise.functions.terms import Term, found_values, with_found_terms
from shelfwise.functions.text import (
    blank_to_null, csv_to_array, list_or_text, present,
)
from shelfwise.session import dealt
from shelfwise.sources.schemas import NOTE_CATEGORIES, NOTES, PAYLOAD
from shelfwise.sources.sinks import replace_by_key

# Primary processes, roast classes, dense-bean limit, varietals that rest longer.
PRIMARY_PROCESSES = ("Washed", "Natural", "Honey")
DARK_ROASTS = ("Dark", "Espresso")
LIGHT_ROASTS = ("Light", "Filter")
AFRICAN_VARIETALS = ("SL28", "SL34", "Ruiru 11", "Batian")
DENSE_ABOVE_METRES = 1600
FEET_TO_METRES = 0.3048


def _terms(kind: str, role: str, *values: str) -> list[Term]:
    return [Term(kind, value.lower(), value, role) for value in values]


# The dictionary a catalog starts with. Pass another one for other catalogs.
DICTIONARY: list[Term] = [
    *_terms(
        "country", "", "Brazil", "Burundi", "Colombia", "Costa Rica", "El Salvador", "Ethiopia",
        "Guatemala", "Honduras", "India", "Indonesia", "Kenya", "Mexico", "Nicaragua", "Panama",
        "Papua New Guinea", "Peru", "Rwanda", "Tanzania", "Uganda", "Yemen",
    ),
    *_terms("region", "Ethiopia", "Yirgacheffe", "Sidama", "Guji"),
    *_terms("region", "Colombia", "Huila", "Nariño", "Tolima"),
    *_terms("region", "Guatemala", "Huehuetenango", "Antigua"),
    *_terms("region", "Kenya", "Nyeri", "Kirinyaga"),
    *_terms("region", "Costa Rica", "Tarrazú"),
    *_terms("region", "Panama", "Boquete"),
    Term("roast", "light roast", "Light"), Term("roast", "filter roast", "Filter"),
    Term("roast", "medium roast", "Medium"), Term("roast", "dark roast", "Dark"),
    Term("roast", "espresso roast", "Espresso"),
    *_terms("process", "primary", *PRIMARY_PROCESSES),
    *_terms("process", "secondary", "Anaerobic", "Carbonic Maceration", "Double Fermented"),
    *_terms("process", "other", "Thermal Shock", "Co Fermented", "Yeast Inoculated"),
    *_terms(
        "varietal", "", "Bourbon", "Pink Bourbon", "Typica", "Caturra", "Catuai", "Castillo",
        "Gesha", "Pacamara", "Heirloom", "Maragogype",
    ),
    *_terms("varietal", "african", *AFRICAN_VARIETALS),
    *_terms("fruits", "", "Apple", "Blueberry", "Cherry", "Lemon", "Orange", "Peach", "Raspberry"),
    *_terms("sweets", "", "Caramel", "Chocolate", "Dark Chocolate", "Honeycomb", "Toffee"),
    *_terms("florals", "", "Jasmine", "Rose", "Lavender", "Hibiscus"),
    *_terms("spices", "", "Cinnamon", "Clove", "Nutmeg", "Cardamom"),
    *_terms("others", "", "Black Tea", "Almond", "Hazelnut", "Tobacco"),
]


def to_enrich(
    beans: DataFrame, products: DataFrame, details: DataFrame, retry_failed: bool = False
) -> DataFrame:
    """Catalog products without attributes, with the texts to read them from.

    The wide text columns join only the products that are left. ``retry_failed`` also returns
    products whose last reading failed.
    """
    done = details
    if retry_failed:
        done = details.filter(F.coalesce(F.col("status"), F.lit("ok")) != "failed")
    missing = (
        beans.select("product_id", "parent_title", "product_url")
        .distinct()
        .join(done.select("product_id"), "product_id", "left_anti")
    )
    texts = products.select(F.col("id").alias("product_id"), "title", "body_html", "tags")
    return missing.join(texts, "product_id")


def first_images(images: DataFrame) -> DataFrame:
    """The image in first position of each product."""
    return (
        images.filter("position = 1").groupBy("product_id").agg(F.min("src").alias("image_url"))
    )


def product_by_url(urls: DataFrame, products: DataFrame) -> DataFrame:
    """Product id of each url; of several products with one url the lowest id."""
    first = products.groupBy("url").agg(F.min("id").alias("product_id"))
    return urls.join(first, "url", "left")


def page_texts(pages: DataFrame, fragment: str = "desc") -> DataFrame:
    """Description text per url; of several pages with one url the first.

    The text is taken out before anything is shuffled: it is a small part of the page. An empty
    page has no text, a page without a description an empty one.
    """
    text = F.when(present(F.col("html")), region_text(F.col("html"), fragment))
    texts = pages.select("url", "page_id", text.alias("text"))
    return texts.groupBy("url").agg(F.min_by("text", "page_id").alias("page_text"))


def assembled_text(title: Column, description: Column, page: Column, tags: Column) -> Column:
    """The sections that exist, each below its label. ``tags`` is comma text."""

    def section(label: str, text: Column, shown: Column) -> Column:
        return F.when(shown, F.concat(F.lit(f"[{label}]\n"), text))

    return F.concat_ws(
        "\n\n",
        section("title", title, present(title)),
        section("description", description, present(description)),
        section("page", page, page.isNotNull()),
        section("tags", F.array_join(csv_to_array(tags), ", "), present(tags)),
    )


def assemble_documents(products: DataFrame, pages: DataFrame, fragment: str = "desc") -> DataFrame:
    """One text per product from its title, description, page and tags."""
    texts = page_texts(pages, fragment)
    title = F.coalesce(blank_to_null(F.col("parent_title")), F.col("title"))
    return products.join(texts, "url", "left").select(
        F.col("id").alias("product_id"),
        assembled_text(title, F.col("body_html"), F.col("page_text"), F.col("tags")).alias("text"),
    )


def altitude(text: Column) -> Column:
    """Altitude in metres without a unit, ``low-high`` or one number; null when there is none."""
    # Thousands are marked by a comma, or by a dot before three digits.
    amount = r"(\d{1,3}(?:\.\d{3})+|\d[\d,]*)"
    pattern = (
        rf"(?i)(?=\d)(?:{amount}\s*(?:masl|m|ft)?\s*(?:-|–|to)\s*)?{amount}\s*"
        r"(masl|metres|meters|m|feet|ft)\b"
    )

    def read(span: Column) -> Column:
        digits = [F.translate(F.regexp_extract(span, pattern, n), ",.", "").try_cast("int") for n in (1, 2)]
        return F.struct(
            F.lower(span).rlike("f(ee)?t$").alias("feet"), *[d.alias(n) for d, n in zip(digits, ("low", "high"))]
        )

    def written(amounts: Column) -> Column:
        def metres(number: Column) -> Column:
            return F.when(amounts["feet"], F.round(number * FEET_TO_METRES).cast("int")).otherwise(number)

        return F.concat_ws("-", metres(amounts["low"]), metres(amounts["high"]))

    # Arrays of one element make the search through the whole text, and each reading of what it
    # found, run once per row.
    span = F.array(F.regexp_substr(text, F.lit(pattern)))
    amounts = F.transform(span, lambda s: F.when(s.isNotNull(), read(s)))
    texts = F.transform(amounts, lambda a: F.when(a.isNotNull(), written(a)))
    return F.transform(texts, blank_to_null)[0]


def highest_metres(altitude_text: Column) -> Column:
    return F.element_at(F.split(altitude_text, "-"), -1).try_cast("int")


def labelled(text: Column, *labels: str) -> Column:
    """Rest of the first line that starts with one of the labels and a colon."""
    pattern = r"(?im)^[ \t]*(?:" + "|".join(labels) + r")[ \t]*:[ \t]*(.*?)[ \t\r]*$"
    return blank_to_null(F.regexp_extract(text, pattern, 1))


def grower(text: Column, roaster_name: Column | None = None) -> Column:
    """The named producer, unless that is the seller itself."""
    name = labelled(text, "producer", "producers", "grower")
    if roaster_name is None:
        return name
    return F.when(F.lower(name).eqNullSafe(F.lower(roaster_name)), None).otherwise(name)


def resting_range(
    process: Column, roast: Column, varietals: Column, metres: Column
) -> tuple[Column, Column]:
    """Fewest and most days of rest; null for an unknown process."""
    methods = F.split(process, "; ")
    washed = F.array_contains(methods, "Washed")
    fruity = F.arrays_overlap(methods, F.array(F.lit("Natural"), F.lit("Honey")))
    dark, light = roast.isin(*DARK_ROASTS), roast.isin(*LIGHT_ROASTS)
    african = F.arrays_overlap(varietals, F.array(*[F.lit(v) for v in AFRICAN_VARIETALS]))
    dense = metres > DENSE_ABOVE_METRES

    def days(fruity_days: int, washed_days: int, darker: int, lighter: int, longer: int) -> Column:
        return (
            F.when(fruity, fruity_days).when(washed, washed_days)
            + F.when(dark, -darker).when(light, lighter).otherwise(0)
            + F.when(african, longer).otherwise(0)
            + F.when(dense, longer).otherwise(0)
        )

    return days(10, 7, 3, 2, 1), days(14, 10, 2, 3, 2)


def resting_days(low: Column, high: Column) -> Column:
    return F.floor((low + high) / 2).cast("int")


def _one(values: Column) -> Column:
    return F.when(F.size(values) > 0, values[0])


def implied_places(dictionary: list[Term]) -> list[Term]:
    """What the places of a dictionary lie in: regions of areas, countries of regions and areas.

    The role of an ``area`` is its region, that of a ``region`` its country. A name that stands for
    places in two regions, or in two countries, leaves that level open: the text must name it.
    """
    countries: dict[str, set[str]] = {}
    for entry in dictionary:
        if entry.kind == "region":
            countries.setdefault(entry.value, set()).add(entry.role)
    inside: dict[str, tuple[set[str], set[str]]] = {}
    for entry in dictionary:
        if entry.kind in ("area", "region"):
            regions, lands = inside.setdefault(entry.term, (set(), set()))
            region = entry.role if entry.kind == "area" else entry.value
            regions.add(region)
            # A region's own entry says where it lies, though others share its name.
            lands |= {entry.role} if entry.kind == "region" else countries.get(region, set())
    implied = [Term("region", term, *r) for term, (r, _) in inside.items() if len(r) == 1]
    implied += [Term("country", term, *c) for term, (_, c) in inside.items() if len(c) == 1]
    return implied


def extract_attributes(
    texts: DataFrame,
    dictionary: list[Term] = DICTIONARY,
    text: str = "text",
    roaster_name: str | None = None,
) -> DataFrame:
    """Attributes of each text by dictionary and rules; one narrow pass, no shuffle.

    Adds the columns of the attribute payload. A place implies what it lies in (``implied_places``).
    The text is a blend if it says so or names several countries or regions, and of single origin if
    it names one region, an area, a farm or a producer; a country alone leaves that open.
    """
    body = F.col(text)
    seller = F.col(roaster_name) if roaster_name else None
    everything = [*dictionary, *implied_places(dictionary), Term("blend", "blend", "blend")]
    found = F.col("_found")

    def values(kind: str, role: str | None = None) -> Column:
        return found_values(found, kind, role)

    process = F.array_join(
        F.concat(*[values("process", role) for role in ("primary", "secondary", "other")]), "; "
    )
    notes = F.struct(*[values(category).alias(category) for category in NOTE_CATEGORIES])
    marked = with_found_terms(texts, text, everything).withColumns(
        {
            "_countries": values("country"),
            "_regions": values("region"),
            "_areas": values("area"),
            "_blend": F.size(values("blend")) > 0,
            "roast_level": _one(values("roast")),
            "processing_method": blank_to_null(process),
            "varietals": values("varietal"),
            "altitude": altitude(body),
            "farm": labelled(body, "farm", "finca", "estate"),
            "producer": grower(body, seller),
            "tasting_notes": notes,
        }
    )
    several = F.col("_blend") | (F.size("_countries") > 1) | (F.size("_regions") > 1)
    one = (
        (F.size("_regions") == 1)
        | (F.size("_areas") == 1)
        | F.col("farm").isNotNull()
        | F.col("producer").isNotNull()
    )
    low, high = resting_range(
        F.col("processing_method"), F.col("roast_level"), F.col("varietals"),
        highest_metres(F.col("altitude")),
    )
    with_rules = marked.withColumns(
        {
            "is_single_origin": F.when(several, False).when(one, True),
            "origin": F.struct(
                _one(F.col("_countries")).alias("country"), _one(F.col("_regions")).alias("region")
            ),
            "resting_period_days": resting_days(low, high),
        }
    )
    return with_rules.withColumn("confidence_score", confidence()).drop(
        "_found", "_countries", "_regions", "_areas", "_blend"
    )


def confidence() -> Column:
    """Share of the nine attributes that were found."""
    notes = F.concat(*[F.col(f"tasting_notes.{category}") for category in NOTE_CATEGORIES])
    filled = [
        *[
            F.col(name).isNotNull()
            for name in (
                "is_single_origin", "origin.country", "roast_level", "processing_method",
                "altitude", "farm", "producer",
            )
        ],
        F.size("varietals") > 0,
        F.size(notes) > 0,
    ]
    return F.round(sum(f.cast("int") for f in filled) / len(filled), 4)


def parse_payload(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Read attribute records from JSON text, fill what is missing and say how it went.

    ``status`` is ``failed`` for unreadable text, ``empty`` for a record without attributes, else
    ``ok``. A failed record is the empty one, so it is stored and not read again by default.
    """
    parsed = F.from_json(
        payload, f"{PAYLOAD}, _corrupt_record STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    read = records.withColumn("_j", parsed)
    listed = F.from_json("_j.varietals", "ARRAY<STRING>")
    note_lists = F.struct(
        *[
            F.coalesce(F.col(f"_j.tasting_notes.{c}"), F.array().cast("array<string>")).alias(c)
            for c in NOTE_CATEGORIES
        ]
    )
    failed = F.col(payload).isNull() | F.col("_j._corrupt_record").isNotNull()
    columns = {
        "is_single_origin": F.col("_j.is_single_origin"),
        "origin_country": F.col("_j.origin.country"),
        "origin_region": F.col("_j.origin.region"),
        "roast_level": F.col("_j.roast_level"),
        "processing_method": F.col("_j.processing_method"),
        "varietals": blank_to_null(
            F.when(F.col("_j.varietals").startswith("["), F.array_join(listed, ",")).otherwise(
                F.col("_j.varietals")
            )
        ),
        "altitude": F.col("_j.altitude"),
        "farm": list_or_text(F.col("_j.farm")),
        "producer": F.col("_j.producer"),
        "resting_period_days": F.col("_j.resting_period_days"),
    }
    columns = {name: F.when(~failed, value) for name, value in columns.items()}
    nothing = [value.isNull() for value in columns.values()]
    no_notes = F.size(F.flatten(F.array(*[note_lists[c] for c in NOTE_CATEGORIES]))) == 0
    empty = no_notes
    for missing in nothing:
        empty = empty & missing
    return read.withColumns(
        {
            **columns,
            "tasting_notes": note_lists.cast(NOTES),
            "extraction_confidence": F.when(~failed, F.col("_j.confidence_score")),
            "status": F.when(failed, "failed").when(empty, "empty").otherwise("ok"),
        }
    ).na.fill(0.0, ["extraction_confidence"]).drop("_j")


def detail_rows(extracted: DataFrame, load_ts: datetime) -> DataFrame:
    """Extracted attributes as rows of the details table."""
    flag = F.col("is_single_origin")
    return extracted.select(
        "product_id",
        flag.alias("is_single_origin"),
        F.col("origin.country").alias("origin_country"),
        F.col("origin.region").alias("origin_region"),
        "roast_level", "processing_method",
        blank_to_null(F.array_join("varietals", ",")).alias("varietals"),
        "altitude", "farm", "producer", "tasting_notes", "resting_period_days",
        F.col("confidence_score").alias("extraction_confidence"),
        F.lit(load_ts).alias("last_updated"),
    )


def re_enrich(
    ids: DataFrame,
    documents: DataFrame,
    details: DataFrame,
    load_ts: datetime,
    dictionary: list[Term] = DICTIONARY,
    roaster_name: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read the chosen products again and replace their details.

    Returns the new details table and the ids that no product has.
    """
    wanted = ids.select("product_id").distinct()
    chosen = documents.join(wanted, "product_id", "left_semi")
    fresh = detail_rows(
        extract_attributes(chosen, dictionary, roaster_name=roaster_name), load_ts
    )
    unknown = _without(ids, documents, "product_id")
    return replace_by_key(details, fresh.select(*details.columns), "product_id"), unknown


def _without(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The distinct keys of ``asked`` that ``held`` lacks; a null key is never held.

    One grouping of both: a join would sort both sides, next to the hash table of the distinct keys.
    """
    both = asked.select(key, F.lit(True).alias("_lacks")).union(
        held.filter(F.col(key).isNotNull()).select(key, F.lit(False))
    )
    lacking = dealt(both, key).groupBy(key).agg(F.min("_lacks").alias("_lacks")).filter("_lacks")
    return lacking.select(F.col(key).cast(asked.schema[key].dataType).alias(key))


def notes_long(rows: DataFrame, key: str = "product_id") -> DataFrame:
    """One row per note with its category."""
    lists = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.col(f"tasting_notes.{c}").alias("notes"))
            for c in NOTE_CATEGORIES
        ]
    )
    return (
        rows.select(key, F.explode(lists).alias("entry"))
        .select(key, "entry.category", F.explode("entry.notes").alias("note"))
    )


def notes_text(notes: Column) -> Column:
    """The non-empty categories in display order, each with its notes."""
    parts = [
        F.when(
            F.size(notes[c]) > 0, F.concat(F.lit(f"{c.title()}: "), F.array_join(notes[c], ", "))
        )
        for c in NOTE_CATEGORIES
    ]
    return F.concat_ws("\n", *parts)


def notes_array(notes: Column) -> Column:
    """All notes of all categories."""
    empty = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.coalesce(notes[c], empty) for c in NOTE_CATEGORIES]))
