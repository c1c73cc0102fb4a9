"""Normalized facts as one JSON document, written and read by all executors.

The document has the fixed key order schemaVersion, facts, unsupported, correlation. Executors write the elements of every
array in order, one on each line, as fragments; these are then joined through the file system, as a stream, or stay as the
volumes of a document that is too large for that. A document of this layout is read by lines, which any number of tasks share,
since each element tells by its first keys what it is; any other layout of the same document is read as a whole. A native payload
stands once in an element, under its evidence; other places refer to it, and a join resolves them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.facts import NormalizedFacts, keyed
from ..schemas import PROVIDER, RANGE, REPOSITORY, SOURCE
from ..storage import large, release_shuffles, scratch_path
from . import ordered

_ENTITY = f"struct<canonicalId:string,candidateCanonicalIds:array<string>,id:string,nativeId:string,kind:string,provider:{PROVIDER},correlationStatus:string>"
_REF = "struct<`$ref`:string>"
#: An element of facts or of unsupported. An object is an entity or has a value.
_ELEMENT = (
    f"struct<schemaVersion:int,status:string,factId:string,subject:{_ENTITY},predicate:string,object:struct<canonicalId:string,candidateCanonicalIds:array<string>,id:string,nativeId:string,kind:string,provider:{PROVIDER},correlationStatus:string,value:string>,"
    f"provider:{PROVIDER},repository:{REPOSITORY},source:{SOURCE},derivationClass:string,determinism:string,nativeEvidence:struct<id:string,observation:struct<schemaVersion:int,subject:struct<id:string,kind:string>,predicate:string,"
    f"object:struct<id:string,kind:string,value:string>,provider:{PROVIDER},repository:{REPOSITORY},source:{SOURCE},determinism:string>>,providerNative:{_REF}>")
_MEMBER = f"struct<provider:{PROVIDER},nativeId:string,kind:string,path:string,`range`:{RANGE},repository:{REPOSITORY},canonicalKind:string,name:string,qualifiedName:string,signature:string,aliases:array<string>>"
_CANONICAL = f"struct<canonicalId:string,identity:string,repository:{REPOSITORY},kind:string,status:string,members:array<{_MEMBER}>,candidateCanonicalIds:array<string>,rationale:struct<method:string,reason:string,cardinality:string,rules:array<string>>>"
_LINK = "struct<left:string,right:string,score:int,strength:string,cardinality:string,rules:array<string>>"
_METRIC = f"struct<provider:{PROVIDER},total:long,canonicalEntityCount:long,candidateCount:long,matched:long,probable:long,ambiguous:long,unmatched:long>"
_SKIPPED = "struct<keyClass:string,keyCount:long,skippedKeyCount:long,largestSkippedPairCount:long,complete:boolean>"
_HEAD = '{"schemaVersion":1,"facts":['


def _rest(json: Column) -> Column:
    """An object's text without its last brace."""
    return F.substring(json, F.lit(1), F.length(json) - 1)


def _entity(e: Column, provider: Column) -> Column:
    return F.struct(
        e.canonical_id.alias("canonicalId"), e.candidate_ids.alias("candidateCanonicalIds"), e.native_id.alias("id"), e.native_id.alias("nativeId"), e.kind.alias("kind"), provider.alias("provider"), e.status.alias("correlationStatus"))


def _elements(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts or unsupported evidence as JSON text (``line``), with what they are sorted by."""
    r = rows.join(evidence, "evidence_id", "left")
    ref = F.to_json(F.struct(F.concat(F.lit("nativeEvidence:"), F.col("evidence_id"), F.lit("/providerNative")).alias("$ref")))
    o = F.col("observation")
    said = F.to_json(F.struct(
        o.schemaVersion.alias("schemaVersion"), o.subject.alias("subject"), o.predicate.alias("predicate"), F.struct(o.object.entity.id.alias("id"), o.object.entity.kind.alias("kind"), o.object.value.alias("value")).alias("object"),
        o.provider.alias("provider"), o.repository.alias("repository"), o.source.alias("source"), o.determinism.alias("determinism")))
    quoted = F.to_json(F.array("providerNative"))
    payload = F.when(F.try_parse_json("providerNative").isNotNull(), F.col("providerNative")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    head = F.to_json(F.struct(
        F.lit(1).alias("schemaVersion"), F.col("fact_status").alias("status"), F.col("fact_id").alias("factId"), _entity(F.col("subject"), F.col("provider")).alias("subject"), "predicate"))
    object_ = F.when(F.col("object").isNotNull(), F.to_json(_entity(F.col("object"), F.col("provider")))).otherwise(F.to_json(F.struct("value")))
    tail = F.to_json(F.struct("provider", "repository", "source", F.col("derivation_class").alias("derivationClass"), "determinism"))
    native = F.concat(
        _rest(F.to_json(F.struct(F.col("evidence_id").alias("id"), "provider", "source"))), F.lit(',"observation":'), _rest(said), F.lit(',"providerNative":'), ref, F.lit('},"providerNative":'), F.coalesce(payload, F.lit("null")), F.lit("}"))
    line = F.concat(_rest(head), F.lit(',"object":'), object_, F.lit(","), F.substring(_rest(tail), F.lit(2), F.length(tail)), F.lit(',"nativeEvidence":'), native, F.lit(',"providerNative":'), ref, F.lit("}"))
    return r.select(line.alias("line"), F.coalesce("exact_key", "group_key").alias("k"), F.coalesce("fact_id", "evidence_id").alias("l"))


def _correlation(n: NormalizedFacts) -> list[tuple[str, DataFrame, str]]:
    """(opening, elements, closing) of the arrays and the object below correlation."""
    c = n.correlation
    m = F.struct("provider", F.col("id").alias("nativeId"), "kind", "path", "range", "repository", F.col("family").alias("canonicalKind"), "name", "qualifiedName", "signature", "aliases")
    members = c.members.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct(F.to_json("provider").alias("o"), F.col("id").alias("i"), m.alias("m")))).alias("ms"))  # one for each provider at most
    canonical = c.canonical.join(members, "canonical_id").select(F.to_json(F.struct(
        F.col("canonical_id").alias("canonicalId"), F.col("canonical_id").alias("identity"), "repository", "kind", "status", F.transform("ms", lambda x: x.m).alias("members"), F.col("candidate_ids").alias("candidateCanonicalIds"),
        F.struct(F.lit("deterministic-rules").alias("method"), "reason", "cardinality", "rules").alias("rationale"))).alias("line"), F.col("canonical_id").alias("k"), F.lit("").alias("l"))
    links = c.links.select(F.to_json(F.struct("left", "right", "score", "strength", "cardinality", "rules")).alias("line"), F.col("left").alias("k"), F.col("right").alias("l"))
    metric = F.to_json(F.struct("provider", "total", F.col("canonical").alias("canonicalEntityCount"), F.col("candidates").alias("candidateCount"), "matched", "probable", "ambiguous", "unmatched"))
    name = F.to_json(F.array("provider.id"))
    metrics = c.metrics.select(F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), metric).alias("line"), F.col("provider.id").alias("k"), F.col("provider.version").alias("l"))
    skipped = c.diagnostics.select(F.to_json(F.struct(
        F.col("class").alias("keyClass"), F.col("keys").alias("keyCount"), F.col("skipped_keys").alias("skippedKeyCount"), F.col("largest_skipped_pairs").alias("largestSkippedPairCount"), "complete")).alias("line"), F.col("class").alias("k"), F.lit("").alias("l"))
    return [('],"correlation":{"canonicalEntities":[', canonical, ""), ('],"links":[', links, ""), ('],"metrics":{', metrics, ""), ('},"diagnostics":{"skippedKeys":[', skipped, "]}}}\n")]


def export_facts(n: NormalizedFacts, path: str, rows_per_fragment: int = ordered.ROWS_PER_FILE, volumes: bool = False) -> None:
    """Write one document; a payload that isn't JSON becomes a JSON string.

    Fragments are compressed. Their bytes pass by the driver, as a stream from file to file, and each is deleted once it is in the document.
    With ``volumes`` the document is a folder, where fragments stay as executors have written them: what its files
    hold, one after the other in the order of :func:`volumes_of`, is the same document, in a fraction of the room. Of each array the
    first fragment alone passes by the driver then.
    """
    spark = n.facts.sparkSession
    sections = [(_HEAD, _elements(n.facts, n.evidence), ""), ('],"unsupported":[', _elements(n.unsupported, n.evidence), ""), *_correlation(n)]
    written = []
    for i, (opening, rows, closing) in enumerate(sections):
        root = f"{path}/{i:02d}" if volumes else scratch_path(spark, "fragments")
        release_shuffles(spark)
        _fragments(rows, root, rows_per_fragment)
        written.append((opening, root, closing))
    release_shuffles(spark)
    if volumes:
        for i, (opening, root, closing) in enumerate(written):
            _join(spark, [(opening, root, "")], f"{path}/{i:02d}.json.gz", 1)
        return _join(spark, [(closing, None, "")], f"{path}/{len(written):02d}.json.gz")
    _join(spark, written, path)
    for _, root, _ in written:
        gone = spark._jvm.org.apache.hadoop.fs.Path(root)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def _join(spark: SparkSession, written: list[tuple[str, str | None, str]], path: str, most: int | None = None) -> None:
    """Texts and the fragments between them, of each folder up to so many that have lines, as one file, compressed if its name says so; fragments are deleted."""
    hadoop, fs_path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(hadoop)
    target = fs_path(path)
    out = target.getFileSystem(hadoop).create(target, True)
    codec = codecs.getCodec(target)
    out = codec.createOutputStream(out) if codec is not None else out
    try:
        for opening, root, closing in written:
            out.write(bytearray((opening + "\n" if root else opening).encode()))
            begun = 0
            for part in _parts(spark, root) if root else ():
                if begun == most:
                    break
                source = fs_path(part)
                fs = source.getFileSystem(hadoop)
                given = codecs.getCodec(source).createInputStream(fs.open(source))
                try:
                    # the first line's comma is left out
                    begun += begun > 0 or given.read() >= 0
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(given, out, 1 << 20, False)
                finally:
                    given.close()
                fs.delete(source, False)
            out.write(bytearray(closing.encode()))
    finally:
        out.close()


def _fragments(rows: DataFrame, root: str, rows_per_fragment: int) -> None:
    """Lines in the order of k, l and themselves, in text files of up to so many lines; every line follows a comma. One shuffle by ranges, nothing else is written."""
    order = ("k", "l", "digest")
    placed = rows.withColumn("digest", F.unhex(F.md5(F.col("line").cast("binary")))).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select(F.concat(F.lit(","), "line").alias("line")).write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", rows_per_fragment).text(f"{root}/data")


def _parts(spark: SparkSession, root: str) -> list[str]:
    """Files of sorted ranges in order: by task, then by the number of the task's file, which may have more digits than others."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/part-*")
    found = [str(s.getPath()) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]
    return sorted(found, key=_place)


def _place(part: str) -> tuple[int, ...]:
    return tuple(map(int, re.search(r"/part-(\d+)-.*-c(\d+)\.[^/]*$", part).groups()))  # type: ignore[union-attr]


def volumes_of(spark: SparkSession, path: str) -> list[str]:
    """Files of a document in volumes in order; each is compressed, and together they are the document."""
    texts = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.json.gz")
    said = sorted(str(s.getPath()) for s in texts.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(texts) or [])
    return [x for text in said for x in (text, *_parts(spark, text.removesuffix(".json.gz")))]


def import_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """facts, unsupported, evidence, canonical, members, links, metrics and diagnostics of a document; another version is an error.

    Keys of facts are worked out anew from what the elements say. References to payloads are resolved through the table
    ``evidence``; one whose evidence isn't in the document keeps its id and has no payload.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    volumes = folder.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(folder)
    first = spark.read.text(f"{path}/00.json.gz" if volumes else path).first()
    head = (first[0] if first else "").strip()
    version = _version(head)
    if version != 1:
        raise ValueError(f"facts of schema version {version} can't be read")
    if head == _HEAD:
        lines = spark.read.option("recursiveFileLookup", volumes).text(path).select(F.regexp_replace("value", "^,", "").alias("line"))
        # other lines become null before anything is parsed, whatever filter the optimizer moves below
        of = lambda start: lines.select(F.when(F.startswith("line", F.lit(start)), F.col("line")).alias("line")).where("line is not null")
        said, canonical, links, skipped = of('{"schemaVersion":1,"status":'), of('{"canonicalId":'), of('{"left":'), of('{"keyClass":')
        metrics = of('"').select(F.regexp_replace("line", r'^"(?:[^"\\]|\\.)*":', "").alias("line"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        each = lambda where: whole.select(F.explode(F.coalesce(F.try_variant_get("v", where, "array<variant>"), F.array().cast("array<variant>"))).alias("x")).select(F.to_json("x").alias("line"))
        said = each("$.facts").union(each("$.unsupported"))
        canonical, links, skipped = each("$.correlation.canonicalEntities"), each("$.correlation.links"), each("$.correlation.diagnostics.skippedKeys")
        metrics = whole.select(F.explode(F.coalesce(F.try_variant_get("v", "$.correlation.metrics", "map<string,variant>"), F.create_map().cast("map<string,variant>"))).alias("k", "x")).select(F.to_json("x").alias("line"))
    return _facts_of(said) | _correlation_of(canonical, links, metrics, skipped)


def _version(head: str) -> int | None:
    found = re.match(r'\{\s*"schemaVersion"\s*:\s*(\d+)', head)
    return int(found[1]) if found else None


def _facts_of(said: DataFrame) -> dict[str, DataFrame]:
    e = said.select(F.from_json("line", _ELEMENT, {"mode": "FAILFAST"}).alias("e"), "line")
    reference = lambda c: F.struct(c.canonicalId.alias("canonical_id"), c.candidateCanonicalIds.alias("candidate_ids"), c.nativeId.alias("native_id"), c.kind.alias("kind"), c.correlationStatus.alias("status"))
    pointed = F.nullif(F.regexp_extract("e.providerNative.$ref", r"^nativeEvidence:(.+)/providerNative$", 1), F.lit(""))
    rows = e.select(
        "e.repository", "e.provider", "e.predicate", reference(F.col("e.subject")).alias("x"), F.when(F.col("e.object.nativeId").isNotNull(), reference(F.col("e.object"))).alias("y"), F.col("e.object.value").alias("value"), "e.source", "e.determinism",
        F.col("e.derivationClass").alias("derivation_class"), F.coalesce(pointed, "e.nativeEvidence.id").alias("evidence_id"))
    rows = keyed(rows)
    text = F.try_variant_get(F.try_parse_json("line"), "$.nativeEvidence.providerNative", "variant")
    native = F.when(F.schema_of_variant(text) == "STRING", F.to_json(text)).otherwise(F.get_json_object("line", "$.nativeEvidence.providerNative"))
    o = F.col("e.nativeEvidence.observation")
    entity = F.when(o.object.id.isNotNull(), F.struct(o.object.id.alias("id"), o.object.kind.alias("kind")))
    kept = F.struct(o.schemaVersion.alias("schemaVersion"), o.subject.alias("subject"), o.predicate.alias("predicate"), F.struct(entity.alias("entity"), F.when(entity.isNull(), o.object.value).alias("value")).alias("object"), o.provider.alias("provider"), o.repository.alias("repository"), o.source.alias("source"), o.determinism.alias("determinism"))
    evidence = e.select(F.col("e.nativeEvidence.id").alias("evidence_id"), native.alias("providerNative"), kept.alias("observation")).where("evidence_id is not null").drop_duplicates(["evidence_id"])
    common = S.is_common(F.col("predicate"))
    return {"facts": rows.where(common), "unsupported": rows.where(~common), "evidence": large(evidence)}


def _correlation_of(canonical: DataFrame, links: DataFrame, metrics: DataFrame, skipped: DataFrame) -> dict[str, DataFrame]:
    read = lambda df, kind: df.select(F.from_json("line", kind, {"mode": "FAILFAST"}).alias("e"))
    c = read(canonical, _CANONICAL)
    entities = c.select(F.col("e.canonicalId").alias("canonical_id"), "e.repository", "e.kind", "e.status", "e.rationale.cardinality", "e.rationale.rules", F.size("e.members").alias("n_members"), F.col("e.candidateCanonicalIds").alias("candidate_ids"), "e.rationale.reason")
    members = c.select(F.col("e.canonicalId").alias("canonical_id"), F.col("e.status").alias("status"), F.col("e.candidateCanonicalIds").alias("candidate_ids"), F.explode("e.members").alias("m")).select(
        "canonical_id", "status", "candidate_ids", "m.provider", "m.repository", F.col("m.nativeId").alias("id"), "m.kind", F.col("m.canonicalKind").alias("family"), "m.path", "m.range", "m.name", "m.qualifiedName", "m.signature", "m.aliases")
    return {
        "canonical": entities, "members": members, "links": read(links, _LINK).select("e.*"),
        "metrics": read(metrics, _METRIC).select("e.provider", "e.total", F.col("e.canonicalEntityCount").alias("canonical"), F.col("e.candidateCount").alias("candidates"), "e.matched", "e.probable", "e.ambiguous", "e.unmatched"),
        "diagnostics": read(skipped, _SKIPPED).select(F.col("e.keyClass").alias("class"), F.col("e.keyCount").alias("keys"), F.col("e.skippedKeyCount").alias("skipped_keys"), F.col("e.largestSkippedPairCount").alias("largest_skipped_pairs"), "e.complete")}
