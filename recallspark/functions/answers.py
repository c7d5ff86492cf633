"""What language models answer, as columns: structures out of tolerant JSON, with defaults for what is missing.

Each parser gives null where an answer is no such structure; a caller that must have one checks for that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .codec import tolerant_json

GRAPH = "struct<entities:array<struct<name:string,type:string,description:string>>,relationships:array<struct<source:string,target:string,description:string>>>"
REFLECTIONS = "struct<reflections:array<struct<question:string,insight:string,evidence_ids:array<string>>>>"
COMMUNITY = "struct<title:string,summary:string,findings:array<string>>"
VERDICT = "struct<contradicts:boolean,confidence:double,reason:string,newer_is_authoritative:boolean,suggested_merge:string>"

# The kinds of entities.
ENTITY_TYPES = ["PERSON", "PLACE", "ORGANIZATION", "OBJECT", "CONCEPT"]


def _blank(x: Column) -> Column:
    return F.length(F.trim(F.coalesce(x, F.lit("")))) == 0


def _is_array(json: Column) -> Column:
    return F.ltrim(json).startswith("[")


def silent(answer: Column) -> Column:
    """Whether nothing is left of an answer but the model's reasoning."""
    return _blank(text.strip_thinking(F.coalesce(answer, F.lit(""))))


def answer_json(answer: Column) -> Column:
    """The JSON of an answer as text: mended, and out of a tool call (name, tool or function with arguments) if it is wrapped in one."""
    json = tolerant_json(text.strip_thinking(answer))
    arguments = F.get_json_object(json, "$.arguments")
    call = F.coalesce(F.get_json_object(json, "$.name"), F.get_json_object(json, "$.tool"), F.get_json_object(json, "$.function")).isNotNull()
    return F.when(call & arguments.isNotNull(), tolerant_json(arguments)).otherwise(json)


def answer_object(answer: Column, bare: str | None = None) -> Column:
    """The JSON object of an answer as text: the first element of a bare array; a bare text becomes the field ``bare`` where that is given."""
    json = answer_json(answer)
    one = F.when(_is_array(json), F.get_json_object(json, "$[0]")).otherwise(json)
    if bare is None:
        return one
    plain = F.trim(text.strip_fences(text.strip_thinking(answer)))
    word = F.when(json.isNull(), F.regexp_replace(plain, '^"|"$', "")).when(~F.ltrim(one).startswith("{"), one)
    return F.when(~_blank(word), F.to_json(F.struct(word.alias(bare)))).otherwise(one)


def parse_graph(answer: Column) -> Column:
    """Entities and relationships. A bare array holds entities; those without a name or a known type, and relationships without both ends, are left out.

    A silent answer has neither.
    """
    json = answer_json(answer)
    read = F.when(_is_array(json), F.from_json(F.concat(F.lit('{"entities":'), json, F.lit("}")), GRAPH)).otherwise(F.from_json(json, GRAPH))
    none = F.from_json(F.lit("{}"), GRAPH)
    found = F.when(silent(answer), none).otherwise(read)
    entities = F.filter(F.coalesce(found["entities"], F.from_json(F.lit("[]"), GRAPH.split("entities:")[1].split(",relationships")[0])), lambda e: ~_blank(e["name"]) & F.upper(e["type"]).isin(ENTITY_TYPES))
    entities = F.transform(entities, lambda e: F.struct(e["name"].alias("name"), F.upper(e["type"]).alias("type"), F.coalesce(e["description"], F.lit("")).alias("description")))
    links = F.filter(F.coalesce(found["relationships"], F.from_json(F.lit("[]"), GRAPH.split("relationships:")[1][:-1])), lambda r: ~_blank(r["source"]) & ~_blank(r["target"]))
    links = F.transform(links, lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), F.coalesce(r["description"], F.lit("")).alias("description")))
    return F.when(found.isNotNull(), F.struct(entities.alias("entities"), links.alias("relationships")))


def _last_of_each(entries: Column, key: str) -> Column:
    """A map of (key, value) entries; of a repeated key the last one counts."""

    def of(all_: Column) -> Column:
        return F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda x: x[key] == e[key])))

    # the array of one gives the entries a name, as what comes from Python can't be named again within a lambda
    return F.element_at(F.transform(F.array(entries), of), 1)


def parse_reclassified(answer: Column) -> Column:
    """Map of id to whether a memory is transient, from a bare array or one named classifications, results or items; null if an entry lacks either."""
    json = answer_json(answer)
    rows = F.when(_is_array(json), json).otherwise(F.coalesce(*[F.get_json_object(json, f"$.{n}") for n in ("classifications", "results", "items")]))
    read = F.from_json(rows, "array<struct<id:string,is_transient:boolean>>")
    whole = F.forall(read, lambda r: r["id"].isNotNull() & r["is_transient"].isNotNull())
    return F.when(whole, _last_of_each(read, "id"))


def parse_reflections(answer: Column) -> Column:
    """Array of (question, insight, evidence_ids) without identifiers that leak into texts; empty for a silent answer."""
    read = F.from_json(answer_object(answer), REFLECTIONS)["reflections"]
    clean = F.transform(read, lambda r: F.struct(text.strip_ids(r["question"]).alias("question"), text.strip_ids(r["insight"]).alias("insight"), F.coalesce(r["evidence_ids"], F.array().cast("array<string>")).alias("evidence_ids")))
    none = F.from_json(F.lit("[]"), REFLECTIONS.split("reflections:")[1][:-1])
    return F.when(silent(answer), none).otherwise(F.filter(clean, lambda r: ~_blank(r["question"]) & ~_blank(r["insight"])))


def parse_community(answer: Column) -> Column:
    """Title, summary and one to five findings of a community."""
    read = F.from_json(answer_object(answer), COMMUNITY)
    return F.when(~_blank(read["title"]) & ~_blank(read["summary"]) & F.size(read["findings"]).between(1, 5), read)


def parse_global(answer: Column, at_least: int = 50) -> Column:
    """The summary of a story's state, also as a bare text."""
    read = F.get_json_object(answer_object(answer, "global_summary"), "$.global_summary")
    return F.when(F.length(read) >= at_least, read)


def parse_consolidated(answer: Column) -> Column:
    """The one description that stands for several, also as a bare text."""
    return F.nullif(F.get_json_object(answer_object(answer, "consolidated_description"), "$.consolidated_description"), F.lit(""))


def parse_verdict(answer: Column) -> Column:
    """Whether two memories contradict each other; confidence 0.5, an authoritative newer one and no merge where these are missing or out of range."""
    read = F.from_json(answer_object(answer, "reason"), VERDICT)
    sure = F.when(read["confidence"].between(0, 1), read["confidence"]).otherwise(F.lit(0.5))
    full = F.struct(
        read["contradicts"].alias("contradicts"), sure.alias("confidence"), read["reason"].alias("reason"),
        F.coalesce(read["newer_is_authoritative"], F.lit(True)).alias("newer_is_authoritative"), F.nullif(read["suggested_merge"], F.lit("")).alias("suggested_merge"),
    )
    return F.when(read["contradicts"].isNotNull() & ~_blank(read["reason"]), full)


def parse_ranking(payload: Column, n: Column) -> Column:
    """Array of (index, score), best first, out of the forms in which rerankers answer: results or data with entries, or a plain list of scores.

    An entry's own place stands for an index that is missing or out of 0 .. n - 1; entries without a usable one are dropped, and a missing score is 0.
    """
    fields = ("index", "idx", "documentIndex", "document_index", "position")
    marks = ("score", "relevance_score", "relevanceScore", "similarity", "value")
    entry = "array<struct<" + ",".join([f"{f}:string" for f in fields] + [f"{m}:string" for m in marks]) + ">>"
    read = F.coalesce(F.from_json(F.get_json_object(payload, "$.results"), entry), F.from_json(F.get_json_object(payload, "$.data"), entry))

    def resolved(e: Column, i: Column) -> Column:
        places = [F.when(e[f].rlike(r"^\d{1,9}$") & (e[f].try_cast("int") < n), e[f].try_cast("int")) for f in fields]
        value = F.coalesce(F.coalesce(*[e[m] for m in marks]).try_cast("double"), F.lit(0.0))
        return F.struct(F.coalesce(*places, F.when(i < n, i)).alias("index"), value.alias("score"))

    listed = F.filter(F.transform(read, resolved), lambda r: r["index"].isNotNull())
    plain = F.from_json(F.get_json_object(payload, "$.scores"), "array<string>")
    scores = F.transform(plain, lambda s, i: F.struct(i.alias("index"), F.coalesce(s.try_cast("double"), F.lit(0.0)).alias("score")))
    found = F.coalesce(F.when(F.size(listed) > 0, listed), scores, F.slice(listed, 1, 0))
    placed = F.transform(found, lambda r, i: F.struct((-r["score"]).alias("s"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(placed), lambda x: x["r"])


def rename_keys(values: Column, names: Column) -> Column:
    """A map with its keys as ``names`` (a map of lower-case to canonical) writes them; of keys that become one the last value counts."""
    entries = F.transform(F.map_entries(values), lambda e: F.struct(F.coalesce(F.element_at(names, F.lower(e["key"])), e["key"]).alias("key"), e["value"].alias("value")))
    return _last_of_each(entries, "key")


def new_id(kind: str = "mem") -> Column:
    """An identifier of the current time and a random part."""
    return F.concat(F.lit(kind + "_"), F.unix_millis(F.current_timestamp()).cast("string"), F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 9))
