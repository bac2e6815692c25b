"""Metadata maps: lookups, domains, keys, and the typed camera and coordinate systems in them.

A field's key is NAMESPACE.DOMAIN.NAME. The namespace is a parameter, as files of others have their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "image"
DOMAINS = ("spice", "camera", "crs", "layers", "provenance")
TYPED_DOMAINS = ("camera", "crs")

# Body numbers and reference frames that have names.
BODIES = {"301": "Moon", "399": "Earth", "499": "Mars", "599": "Jupiter", "699": "Saturn", "799": "Uranus", "899": "Neptune"}
FRAMES = ("J2000", "IAU_MOON", "IAU_EARTH", "spacecraft", "camera")
PROJECTIONS = ("equirectangular", "stereographic", "sinusoidal", "orthographic")
LENSES = ("pinhole", "fisheye", "pushbroom")


def _error(code: str, message: str) -> Column:
    return F.raise_error(F.lit(f"{code}: {message}"))


def key_problem(key: Column, namespace: str = NAMESPACE) -> Column:
    """Why a generic extension key is refused: null if it is fine, else one of three messages."""
    shape = key.rlike(rf"^{namespace}\.[^.]+\..+$")
    typed = F.lit(False)
    for d in TYPED_DOMAINS:
        typed = typed | key.startswith(f"{namespace}.{d}.")
    return F.when(~key.startswith(f"{namespace}."), "not in the namespace").when(~shape, "needs a domain and a name").when(typed, "domain is typed")


def with_key(fields: Column, key: Column, value: Column, namespace: str = NAMESPACE) -> Column:
    """fields with a key set; a refused key raises."""
    problem = key_problem(key, namespace)
    return F.when(problem.isNull(), upsert(fields, key, value)).otherwise(F.raise_error(F.concat(F.lit("INVALID_ARGUMENT: "), key, F.lit(" "), problem)))


def upsert(fields: Column, key: Column, value: Column) -> Column:
    """The later value wins, whatever the session's policy for repeated keys."""
    return F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(key, value))


def lookup(fields: Column, key: str | Column, default: Column | None = None) -> Column:
    """A field's value; absent: the default, or null."""
    found = F.try_element_at(fields, key if isinstance(key, Column) else F.lit(key))
    return found if default is None else F.coalesce(found, default)


def required(fields: Column, key: str) -> Column:
    found = F.try_element_at(fields, F.lit(key))
    return F.when(found.isNotNull(), found).otherwise(_error("NOT_FOUND", key))


def parameter(parameters: Column, key: str) -> Column:
    """A lens's, a projection's or a geometry's parameter; one that is absent raises NOT_FOUND."""
    return F.when(F.map_contains_key(parameters, F.lit(key)), F.try_element_at(parameters, F.lit(key))).otherwise(_error("NOT_FOUND", key))


def lens_kind(name: Column) -> Column:
    """The known kind that a name stands for; unknown ones are pinholes."""
    return F.when(name.isin(*LENSES), name).otherwise("pinhole")


def crs_identifier() -> Column:
    """Has never been defined."""
    return _error("NOT_IMPLEMENTED", "identifier of a coordinate system").cast("string")


def by_planet(crs: Column) -> list[Column]:
    """To sort by: the name first, which alone decides; all else keeps equal names in a stable order."""
    return [crs["planet"], crs["iau_id"], crs["frame"]]


def in_order(fields: Column) -> Column:
    """Array of (key, value), ascending by key."""
    return F.array_sort(F.map_entries(fields))


def has_domain(fields: Column, domain: str, namespace: str = NAMESPACE) -> Column:
    return F.exists(F.map_keys(fields), lambda k: k.startswith(f"{namespace}.{domain}."))


def domain(fields: Column, name: str, namespace: str = NAMESPACE) -> Column:
    """The fields of one domain, without the prefix."""
    prefix = f"{namespace}.{name}."
    return F.transform_keys(F.map_filter(fields, lambda k, _: k.startswith(prefix)), lambda k, _: F.substring(k, len(prefix) + 1, 1 << 30))


def camera(fields: Column, namespace: str = NAMESPACE) -> Column:
    """Typed camera: null if the domain is absent or partial; a number that isn't one raises INVALID_ARGUMENT."""
    f = domain(fields, "camera", namespace)

    def number(name: str) -> Column:
        raw = F.try_element_at(f, F.lit(name))
        value = raw.try_cast("double")
        return F.when(raw.isNull(), F.lit(None).cast("double")).when(value.isNull(), _error("INVALID_ARGUMENT", f"camera field {name} is no number")).otherwise(value)

    inner = [number(n) for n in ("focal_length_x", "focal_length_y", "principal_x", "principal_y")]
    turn, place = [f"rotation_{a}" for a in "wxyz"], [f"position_{a}" for a in "xyz"]
    whole = F.lit(True)
    for n in turn + place:
        whole = whole & F.try_element_at(f, F.lit(n)).isNotNull()
    defaults = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    outer = [F.when(whole, number(n)).otherwise(F.lit(d)) for n, d in zip(turn + place, defaults, strict=True)]
    lens = F.transform_values(F.transform_keys(F.map_filter(f, lambda k, v: k.startswith("lens.") & v.try_cast("double").isNotNull()), lambda k, _: F.substring(k, 6, 1 << 30)), lambda _, v: v.cast("double"))
    kind = F.coalesce(F.try_element_at(f, F.lit("lens_kind")), F.lit("pinhole"))
    made = F.struct(
        F.try_element_at(f, F.lit("model")).alias("model"), *(c.alias(n) for c, n in zip(inner, ("fx", "fy", "cx", "cy"), strict=True)),
        F.struct(*(c.alias(a) for c, a in zip(outer[:4], "wxyz", strict=True))).alias("rotation"), F.struct(*(c.alias(a) for c, a in zip(outer[4:], "xyz", strict=True))).alias("position"),
        F.coalesce(F.try_element_at(f, F.lit("timestamp")), F.lit("")).alias("timestamp"),
        F.struct(lens_kind(kind).alias("kind"), lens.alias("parameters")).alias("lens"),
    )
    present = F.try_element_at(f, F.lit("model")).isNotNull()
    for n in ("focal_length_x", "focal_length_y", "principal_x", "principal_y"):
        present = present & F.try_element_at(f, F.lit(n)).isNotNull()
    return F.when(present, made)


def camera_fields(c: Column, namespace: str = NAMESPACE) -> Column:
    """Fields of a typed camera; an empty timestamp is left out."""
    pairs = [("model", c["model"]), ("timestamp", c["timestamp"]), ("focal_length_x", c["fx"]), ("focal_length_y", c["fy"]), ("principal_x", c["cx"]), ("principal_y", c["cy"])]
    pairs += [(f"rotation_{a}", c["rotation"][a]) for a in "wxyz"] + [(f"position_{a}", c["position"][a]) for a in "xyz"] + [("lens_kind", c["lens"]["kind"])]
    flat = F.create_map(*(x for k, v in pairs for x in (F.lit(f"{namespace}.camera.{k}"), v.cast("string"))))
    lens = F.transform_values(F.transform_keys(c["lens"]["parameters"], lambda k, _: F.concat(F.lit(f"{namespace}.camera.lens."), k)), lambda _, v: v.cast("string"))
    kept = F.map_filter(flat, lambda k, v: v.isNotNull() & ~(k.endswith(".timestamp") & (v == "")))
    return F.map_concat(kept, F.coalesce(lens, F.create_map().cast("map<string,string>")))


def planet_name(body: Column) -> Column:
    """Of a body number; others name themselves."""
    out = F.when(F.lit(False), F.lit(""))
    for number, name in BODIES.items():
        out = out.when(body == number, name)
    return out.otherwise(body)


def known_frame(frame: Column) -> Column:
    return F.when(frame.isin(*FRAMES), frame)


def projection_kind(kind: Column) -> Column:
    return F.when(kind.isin(*PROJECTIONS), kind).otherwise(_error("INVALID_ARGUMENT", "projection kind"))


def crs(fields: Column, namespace: str = NAMESPACE) -> Column:
    """Typed coordinate system: the registered form has a body, the older one a planet's name, id, axes and projection.

    Unregistered frame ids are kept as they are. Null if the domain is absent or partial.
    """
    f = domain(fields, "crs", namespace)
    get = lambda n: F.try_element_at(f, F.lit(n))
    number = lambda n: F.when(get(n).isNotNull() & get(n).try_cast("double").isNull(), _error("INVALID_ARGUMENT", f"crs field {n} is no number")).otherwise(get(n).try_cast("double"))
    none = F.create_map().cast("map<string,double>")
    body = get("body")
    new = F.struct(
        planet_name(body).alias("planet"), body.alias("iau_id"), F.coalesce(get("reference_frame"), known_frame(body), F.lit("UNSPECIFIED")).alias("frame"),
        F.struct(F.when(get("projection").isNull(), F.lit("equirectangular")).otherwise(projection_kind(get("projection"))).alias("kind"), none.alias("parameters")).alias("projection"),
    )
    parameters = F.transform_values(F.transform_keys(F.map_filter(f, lambda k, v: k.startswith("param.") & v.try_cast("double").isNotNull()), lambda k, _: F.substring(k, 7, 1 << 30)), lambda _, v: v.cast("double"))
    old = F.struct(
        get("planet_name").alias("planet"), get("planet_iau_id").alias("iau_id"), F.coalesce(get("frame"), known_frame(get("planet_iau_id")), F.lit("UNSPECIFIED")).alias("frame"),
        F.struct(projection_kind(get("projection")).alias("kind"), parameters.alias("parameters")).alias("projection"),
    )
    whole = get("planet_name").isNotNull() & get("planet_iau_id").isNotNull() & number("planet_semi_major_m").isNotNull() & number("planet_semi_minor_m").isNotNull() & get("projection").isNotNull()
    return F.when(body.isNotNull(), new).when(whole, old)


def crs_fields(c: Column, namespace: str = NAMESPACE) -> Column:
    """body, projection and reference_frame only."""
    pairs = [("body", c["iau_id"]), ("projection", c["projection"]["kind"]), ("reference_frame", c["frame"])]
    return F.create_map(*(x for k, v in pairs for x in (F.lit(f"{namespace}.crs.{k}"), v)))


def effective_frame(own: Column, planets: Column) -> Column:
    return F.coalesce(own, planets)


def geometry_fields(kind: Column, source_image: Column, parameters: Column, namespace: str = NAMESPACE) -> Column:
    prefix = f"{namespace}.scene.geometry."
    flat = F.map_filter(F.create_map(F.lit(prefix + "kind"), kind, F.lit(prefix + "source_image"), source_image.cast("string")), lambda _, v: v.isNotNull())
    return F.map_concat(flat, F.transform_keys(parameters, lambda k, _: F.concat(F.lit(prefix + "param."), k)))


def geometry(fields: Column, namespace: str = NAMESPACE) -> Column:
    f = domain(fields, "scene.geometry", namespace)
    parameters = F.transform_keys(F.map_filter(f, lambda k, _: k.startswith("param.")), lambda k, _: F.substring(k, 7, 1 << 30))
    return F.when(F.size(f) > 0, F.struct(F.lit("unspecified").alias("kind"), F.try_element_at(f, F.lit("source_image")).try_cast("bigint").alias("source_image"), parameters.alias("parameters")))


def external_id_json(namespace: Column, value: Column, version: Column) -> Column:
    """Canonical JSON; a null version is left out."""
    return F.to_json(F.struct(namespace.alias("namespace"), value.alias("value"), version.alias("version")))


def json_number(n: Column) -> Column:
    """A number up to 2 ** 53, a string beyond."""
    return F.when(n <= (1 << 53), n.cast("string")).otherwise(F.concat(F.lit('"'), n.cast("string"), F.lit('"')))
