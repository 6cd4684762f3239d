"""Decoding and checking of event envelopes.

Reading is lenient the way the producers' contract is: numbers may come as text
(``"5"``) or as ``5.0``, times as ISO text or as an epoch number, flags as words.
Every check is a column expression that cannot fail, so one bad row never stops a batch.

Nearly all events are plain: the JSON kinds are exactly those of the contract. One look
at the document's shape finds them, and they are read with one typed extraction. Only
the others go through the lenient reading and get their problems named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callglass import schema as S
from callglass.functions.frames import built_once, once

# Words read as a flag, and the limit between epoch seconds and milliseconds.
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")
EPOCH_SECONDS_LIMIT = 20_000_000_000

_WHOLE = r"^[+-]?[0-9]+(_[0-9]+)*(\.0*)?$"
_NUMBER = r"^[+-]?[0-9]+(\.[0-9]*)?$"
_ISO = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[Tt _]([0-9]{2}:[0-9]{2})(:[0-9]{2})?(?:[.,]([0-9]{1,6})[0-9]*)?"
    r"(?:([Zz])|([+-][0-9]{2}):?([0-9]{2}))?)?$"
)
_PLAIN_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z$"
_PLAIN_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_INT_FIELDS = ("schema_version", *S.MEASURES)
_TEXT_FIELDS = ("event_type", "provider", "model", "status", "input_preview", "output_preview", "error_type", "error_message",
                "finish_reason")
_UUID_FIELDS = ("conversation_id", "message_id")
_TIME_FIELDS = ("started_at", "completed_at")
_REQUIRED = ("provider", "model", "status", *_TIME_FIELDS)
_NOT_NULL = ("schema_version", "event_type", "streamed", *_REQUIRED)
_WANTED = tuple(k for k in S.KNOWN_KEYS if k != "id")
_LENGTHS = {
    "provider": (1, S.MAX_PROVIDER_CHARS), "model": (1, S.MAX_MODEL_CHARS),
    "error_type": (0, S.MAX_ERROR_TYPE_CHARS), "finish_reason": (0, S.MAX_FINISH_REASON_CHARS),
}


#: Microseconds of the first and last instant of the years 1 to 9999.
EPOCH_MICROS = (-62_135_596_800_000_000, 253_402_300_799_999_999)
#: Forms of an id that refers to another row: plain, hyphenated, in braces, as a URN.
_STRICT_UUID = r"^(?:[0-9A-Fa-f]{32}|(?:urn:uuid:)?H|\{H\})$".replace("H", "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


def canonical_uuid(text: Column) -> Column:
    """Lower-case 8-4-4-4-12 form of any accepted spelling; null when it is none."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(text, r"urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", ""))
    split = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"
    return F.when(text.rlike(_PLAIN_UUID), text).when(
        bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, split, "$1-$2-$3-$4-$5")
    )


@built_once
def _decode_steps(data: str) -> list[Column]:
    raw_id = F.try_variant_get("doc", "$.id", "variant")
    text = F.when(F.schema_of_variant(raw_id) == "STRING", F.try_variant_get("doc", "$.id", "string"))
    dead = F.when(F.col("doc").isNull(), S.REASON_MALFORMED).when(F.col("id").isNull(), S.REASON_NO_ID)
    return [once(doc=F.try_parse_json(data)), once(id=canonical_uuid(text)), dead.alias("dead_reason")]


def decode(envelopes: DataFrame, data: str = "data") -> DataFrame:
    """Adds the parsed document, the event id and the transport-level ``dead_reason``."""
    for step in _decode_steps(data):
        envelopes = envelopes.select("*", step)
    return envelopes


def event_type(doc: str = "doc") -> Column:
    """Event type of a raw row: the default only when the key is absent."""
    given = F.try_variant_get(F.col(doc), "$.event_type", "variant")
    return (
        F.when(given.isNull(), S.EVENT_TYPE).when(F.is_variant_null(given), "None").otherwise(given.cast("string"))
    )


def _is(kind: Column, *names: str) -> Column:
    return F.coalesce(kind.isin(*names), F.lit(False))


def _fractional(kind: Column) -> Column:
    return F.coalesce(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.lit(False))


def _as_long(value: Column, kind: Column) -> Column:
    """Whole number by the lenient rules, else null."""
    number = F.try_variant_get(value, "$", "double")
    text = F.trim(F.try_variant_get(value, "$", "string"))
    digits = F.regexp_replace(F.regexp_replace(text, "_", ""), r"\.0*$", "")
    return (
        F.when(_is(kind, "BIGINT"), F.try_variant_get(value, "$", "bigint"))
        .when(_is(kind, "BOOLEAN"), F.try_variant_get(value, "$", "boolean").cast("bigint"))
        .when(_fractional(kind) & (number == F.floor(number)), F.try_variant_get(value, "$", "bigint"))
        .when(_is(kind, "STRING") & text.rlike(_WHOLE), digits.try_cast("bigint"))
    )


def _as_flag(value: Column, kind: Column) -> Column:
    word = F.lower(F.try_variant_get(value, "$", "string"))
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(_is(kind, "BOOLEAN"), F.try_variant_get(value, "$", "boolean"))
        .when(_is(kind, "BIGINT") | _fractional(kind), F.when(number == 1, True).when(number == 0, False))
        .when(_is(kind, "STRING"), F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False))
    )


def _as_time(value: Column, kind: Column) -> Column:
    """Struct of the instant and whether it carried a zone; instant null when unreadable."""
    text = F.trim(F.try_variant_get(value, "$", "string"))
    part = lambda i: F.regexp_extract(text, _ISO, i)
    clock = F.when(part(2) == "", F.lit("00:00:00")).otherwise(
        F.concat(
            part(2),
            F.when(part(3) == "", ":00").otherwise(part(3)),
            F.when(part(4) == "", "").otherwise(F.concat(F.lit("."), part(4))),
        )
    )
    zone = F.when(part(6) == "", "Z").otherwise(F.concat(part(6), F.lit(":"), part(7)))
    iso = F.concat(part(1), F.lit(" "), clock, zone).try_cast("timestamp")
    zoned = (part(5) != "") | (part(6) != "")
    number = F.when(_is(kind, "STRING"), text.try_cast("double")).otherwise(F.try_variant_get(value, "$", "double"))
    limit = F.lit(float(EPOCH_SECONDS_LIMIT))
    micros = F.when(F.abs(number) <= limit, number * 1e6).otherwise(number * 1e3)
    epoch = F.when(micros.between(*EPOCH_MICROS), F.timestamp_micros(F.rint(micros).cast("bigint")))
    is_epoch = _is(kind, "BIGINT") | _fractional(kind) | (_is(kind, "STRING") & text.rlike(_NUMBER))
    return (
        F.when(is_epoch, F.struct(epoch.alias("at"), F.lit(True).alias("zoned")))
        .when(_is(kind, "STRING") & text.rlike(_ISO), F.struct(iso.alias("at"), zoned.alias("zoned")))
        .otherwise(F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit(False).alias("zoned")))
    )


def _named(fields: Column, *names: str) -> Column:
    """Some of the probed fields, as an array."""
    return F.array(*[fields[_WANTED.index(n)] for n in names])


def _given(e: Column) -> Column:
    return e["kind"].isNotNull() & (e["kind"] != "VOID")


def _told(e: Column, *cases: tuple[Column, str]) -> Column:
    """Messages of the cases that hold for a field."""
    return F.array_compact(F.array(*[F.when(c, F.concat(e["name"], F.lit(f":{m}"))) for c, m in cases]))


def _plain_shape() -> str:
    """Pattern of the shape of a document that needs no leniency; keys are in sorted order there."""
    kinds = {k: "BIGINT" for k in _INT_FIELDS} | {"streamed": "BOOLEAN", "raw_metadata": "OBJECT<[^<>]*>"}
    parts = []
    for key in sorted(S.KNOWN_KEYS):
        kind = kinds.get(key, "STRING")
        if key == "id" or key in _REQUIRED:
            parts.append(f", {key}: {kind}")
        elif key in _NOT_NULL:
            parts.append(f"(?:, {key}: {kind})?")
        else:
            parts.append(f"(?:, {key}: (?:{kind}|VOID))?")
    return "^OBJECT<" + "".join(parts).removeprefix(", ") + ">$"


@built_once
def _plain_steps() -> list[Column]:
    """Give ``_event``, the typed row of a plain valid event, and ``_slow`` for any other row with an id."""
    types = {k: "bigint" for k in _INT_FIELDS} | {"streamed": "boolean", "raw_metadata": "variant"}
    shape = ", ".join(f"{k} {types.get(k, 'string')}" for k in _WANTED)
    plain = F.col("id").isNotNull() & F.schema_of_variant("doc").rlike(_plain_shape())
    p = lambda k: F.col(f"_p.{k}")
    times = {f"_{k}": F.when(p(k).rlike(_PLAIN_TIME), p(k).try_cast("timestamp")) for k in _TIME_FIELDS}
    optional = lambda k, good: p(k).isNull() | good
    ok = [
        F.col("_p").isNotNull(),
        F.col("_completed_at") >= F.col("_started_at"),
        p("status").isin(*S.CALL_STATUSES),
        (p("status") != "error") | (F.length(p("error_message")) > 0),
        optional("event_type", p("event_type") == S.EVENT_TYPE),
        optional("schema_version", p("schema_version").between(-(2**31), 2**31 - 1)),
        *[optional(k, p(k).between(0, 2**31 - 1)) for k in S.MEASURES],
        *[optional(k, F.length(p(k)).between(*_LENGTHS[k])) for k in _LENGTHS],
        *[optional(k, p(k).rlike(_PLAIN_UUID)) for k in _UUID_FIELDS],
    ]
    all_ok = ok[0]
    for c in ok[1:]:
        all_ok = all_ok & c
    values = {"id": F.col("id")} | {k: p(k) for k in _WANTED} | {k: F.col(f"_{k}") for k in _TIME_FIELDS}
    values |= {k: p(k).try_cast("int") for k in _INT_FIELDS}
    values["schema_version"] = F.coalesce(values["schema_version"], F.lit(S.SCHEMA_VERSION))
    values["streamed"] = F.coalesce(p("streamed"), F.lit(False))
    event = F.struct(*[values[c].alias(c) for c in S.EVENT_COLUMNS])
    return [
        once(_p=F.when(plain, F.try_variant_get("doc", "$", f"struct<{shape}>"))),
        once(**times),
        once(_slow=F.col("id").isNotNull() & ~F.coalesce(all_ok, F.lit(False))),
        F.when(F.col("_p").isNotNull() & ~F.col("_slow"), event).alias("_event"),
    ]


@built_once
def _probe_steps() -> list[Column]:
    """Give, for slow rows, each field's raw value and JSON kind, then the values read by type.

    Fields of one type go through one ``transform``, which keeps the generated code small.
    """
    shape = ", ".join(f"{k} variant" for k in _WANTED)
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"_f.{k}").alias("v")) for k in _WANTED])
    fields = F.transform(pairs, lambda e: F.struct(e["name"], e["v"], F.schema_of_variant(e["v"]).alias("kind")))
    f = F.col("_fields")

    def read(value, *names: str) -> Column:
        found = F.transform(
            _named(f, *names), lambda e: F.struct(e["name"], e["kind"], value(e["v"], e["kind"]).alias("value"))
        )
        return F.when(F.col("_slow"), found)

    text = lambda v, kind: F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    typed = once(
        _ints=read(_as_long, *_INT_FIELDS),
        _texts=read(text, *_TEXT_FIELDS),
        _uuids=read(lambda v, kind: F.when(text(v, kind).rlike(_STRICT_UUID), canonical_uuid(text(v, kind))), *_UUID_FIELDS),
        _times=read(_as_time, *_TIME_FIELDS),
        _flags=read(_as_flag, "streamed"),
    )
    return [
        once(_f=F.when(F.col("_slow"), F.try_variant_get("doc", "$", f"struct<{shape}>"))),
        once(_fields=F.when(F.col("_slow"), fields)),
        typed,
    ]


@built_once
def _verdict(data: str) -> Column:
    """Gives ``event`` and ``problems`` from what the plain and the lenient reading found."""
    f = F.col("_fields")
    ints, texts, uuids, times, flag = (F.col(c) for c in ("_ints", "_texts", "_uuids", "_times", "_flags"))
    flag = flag[0]
    metadata, event_kind = f[_WANTED.index("raw_metadata")], f[_WANTED.index("event_type")]
    text = lambda name: texts[_TEXT_FIELDS.index(name)]["value"]
    started, completed = times[0]["value"], times[1]["value"]

    def each(items: Column, *cases) -> Column:
        return F.flatten(F.transform(items, lambda e: _told(e, *[(cond(e), m) for cond, m in cases])))

    def unread(e: Column) -> Column:
        return _given(e) & e["value"].isNull()

    limits = F.create_map(*[F.lit(x) for k, pair in _LENGTHS.items() for x in (k, pair[0])]), F.create_map(
        *[F.lit(x) for k, pair in _LENGTHS.items() for x in (k, pair[1])]
    )
    single = [
        (_given(event_kind) & ~text("event_type").eqNullSafe(F.lit(S.EVENT_TYPE)), "event_type:unknown"),
        (~text("status").isin(*S.CALL_STATUSES), "status:unknown"),
        (_given(metadata) & ~metadata["kind"].startswith("OBJECT"), "raw_metadata:not_an_object"),
        (started["at"].isNotNull() & completed["at"].isNotNull() & (started["zoned"] != completed["zoned"]),
         "timestamp_zone_mismatch"),
        ((started["zoned"] == completed["zoned"]) & (completed["at"] < started["at"]), "completed_at:before_start"),
        ((text("status") == "error") & (F.coalesce(text("error_message"), F.lit("")) == ""), "error_message:missing"),
    ]
    known = F.array(*[F.lit(k) for k in S.KNOWN_KEYS])
    extra = F.array_except(F.json_object_keys(data), known)
    problems = F.concat(
        each(_named(f, *_REQUIRED), (lambda e: e["kind"].isNull(), "missing")),
        each(_named(f, *_NOT_NULL), (lambda e: e["kind"] == "VOID", "null")),
        each(
            ints,
            (unread, "not_an_integer"),
            (lambda e: ~e["value"].between(-(2**31), 2**31 - 1), "out_of_range"),
            (lambda e: (e["value"] < 0) & (e["name"] != "schema_version"), "negative"),
        ),
        each(
            texts,
            (lambda e: unread(e) & (e["name"] != "event_type"), "not_text"),
            (lambda e: ~F.length(e["value"]).between(limits[0][e["name"]], limits[1][e["name"]]), "length"),
        ),
        each(uuids, (unread, "not_a_uuid")),
        each(times, (lambda e: _given(e) & e["value"]["at"].isNull(), "not_a_time")),
        each(F.array(flag), (unread, "not_a_flag")),
        F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in single])),
        F.coalesce(F.transform(extra, lambda k: F.concat(k, F.lit(":unknown_key"))), F.array().cast("array<string>")),
    )
    values = {"id": F.col("id"), "streamed": F.coalesce(flag["value"], F.lit(False))}
    values |= {k: ints[i]["value"].try_cast("int") for i, k in enumerate(_INT_FIELDS)}
    values["schema_version"] = F.coalesce(values["schema_version"], F.lit(S.SCHEMA_VERSION))
    values |= {k: text(k) for k in _TEXT_FIELDS}
    values |= {k: uuids[i]["value"] for i, k in enumerate(_UUID_FIELDS)}
    values |= {"started_at": started["at"], "completed_at": completed["at"]}
    values["raw_metadata"] = F.when(metadata["kind"].startswith("OBJECT"), metadata["v"])
    event = F.struct(*[values[c].alias(c) for c in S.EVENT_COLUMNS])
    slow, none = F.col("_slow"), F.array().cast("array<string>")
    return once(
        event=F.when(slow, event).otherwise(F.col("_event")),
        problems=F.when(slow, problems).when(F.col("id").isNotNull(), none),
    )


def validate(decoded: DataFrame, data: str = "data") -> DataFrame:
    """Adds ``event`` (the typed row) and ``problems`` (empty when the event is valid).

    Rows without a usable id keep null ``problems``.
    """
    checked = decoded
    for step in (*_plain_steps(), *_probe_steps(), _verdict(data)):
        checked = checked.select("*", step)
    return checked.select(*decoded.columns, "event", "problems")


def is_valid() -> Column:
    return F.coalesce(F.size("problems") == 0, F.lit(False))


def reject_reason() -> Column:
    """Why a delivery was set aside; null for a valid one."""
    return F.coalesce(F.col("dead_reason"), F.when(~is_valid(), F.lit(S.REASON_INVALID)))


def to_rows(validated: DataFrame, *extra: str) -> DataFrame:
    """Valid events as log rows: defaults filled, the envelope's event type dropped."""
    return validated.where(is_valid()).select(*extra, "event.*")


def unknown_keys(decoded: DataFrame, data: str = "data") -> DataFrame:
    """How many documents carry each key the contract does not know."""
    known = F.array(*[F.lit(k) for k in S.KNOWN_KEYS])
    keys = decoded.where(F.col("id").isNotNull()).select(
        F.explode(F.array_except(F.json_object_keys(data), known)).alias("key")
    )
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("documents"))


def by_version(rows: DataFrame, shapes: dict[int, dict[str, Column]], version: str = "schema_version") -> DataFrame:
    """One reading per contract version, chosen per row in a single scan.

    ``shapes`` maps a version to its output columns. A column a version lacks is null.
    """
    names = list(dict.fromkeys(name for shape in shapes.values() for name in shape))
    out = []
    for name in names:
        cases = None
        for number, shape in shapes.items():
            if name in shape:
                hit = F.col(version) == number
                cases = F.when(hit, shape[name]) if cases is None else cases.when(hit, shape[name])
        out.append(cases.alias(name))
    return rows.where(F.col(version).isin(*shapes)).select(version, *out)


def publish_json(calls: DataFrame) -> Column:
    """A call as the JSON text of an event. Null fields are left out."""
    fields = [F.col(c) for c in S.EVENT_COLUMNS if c in calls.columns]
    time = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "timeZone": "UTC"}
    return F.to_json(F.struct(F.lit(S.EVENT_TYPE).alias("event_type"), *fields), time)


def publish(calls: DataFrame) -> DataFrame:
    """Calls with their envelope in column ``data``."""
    return calls.withColumn("data", publish_json(calls))
