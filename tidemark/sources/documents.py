"""Versioned JSON documents: read by their version, written whole.

A document says what it is in ``schema_version``. Reading parses each file once into a VARIANT, looks its
version up, and gives it the columns declared for that version: fields that an older document lacks are null, a field of another
type fails the read, and a version that isn't known is refused. Documents are exports of a bounded
number of rows (LIMIT); relations (``tables``) have no such bound.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import json_of
from . import store
from .hourly import opened

#: Rows of a document's longest list.
LIMIT = 100_000

# The documents' fields.
_WINDOW = "`from`:string,`to`:string"
_INTEGRITY = (
    "struct<deduplication_applied:boolean,raw_watch_events_seen:bigint,unique_watch_events:bigint,duplicate_event_ids:bigint,missing_event_ids:bigint,"
    "invalid_event_ids:bigint,invalid_watch_events:bigint,recovered_records:bigint,malformed_records:bigint>"
)
_RATES = "map<string,struct<`limit`:bigint,remaining:bigint,used:bigint,reset:bigint>>"
_PROBLEM = "struct<source:string,target:string,status:int,message:string>"
_PROFILE = (
    "struct<id:bigint,node_id:string,full_name:string,html_url:string,description:string,created_at:string,updated_at:string,pushed_at:string,stars:bigint,forks:bigint,"
    "subscribers:bigint,open_issues_and_pull_requests:bigint,primary_language:string,language_bytes:map<string,bigint>,language_share:map<string,double>,topics:array<string>,"
    "default_branch:string,archived:boolean,visibility:string,license_spdx:string,readme:struct<name:string,path:string,size:bigint,sha:string,html_url:string>,"
    "commits_30d:bigint,contributors_count:bigint,delta_stars_1d:bigint,delta_stars_7d:bigint,delta_stars_30d:bigint,star_velocity_7d:double,star_acceleration:double>"
)
_MODEL = "provider:string,model:string,prompt_version:string,methodology_version:string"
_COVERED = "calendar_complete:boolean,hour_coverage_complete:boolean,record_coverage_complete:boolean,decision_coverage:string,integrity_verification:string"
SCHEMAS = {
    "snapshot-v1": f"schema_version:string,collected_at:string,source:struct<github_api_version:string,authenticated:boolean,coverage_complete:boolean,rate_limit:{_RATES},"
    f"coverage_errors:array<struct<endpoint:string,status:int,message:string>>>,repositories:array<{_PROFILE}>",
    "candidate-v1": f"schema_version:string,window:struct<{_WINDOW}>,source:struct<type:string,coverage_complete:boolean,hours_requested:bigint,hours_collected:bigint,watch_events_seen:bigint,"
    f"repositories_seen:bigint,event_integrity:{_INTEGRITY},github_authenticated:boolean,github_rate_limit:{_RATES},coverage_errors:array<{_PROBLEM}>>,"
    f"repositories:array<struct<full_name:string,watch_events:bigint,first_seen_at:string,last_seen_at:string,github:{_PROFILE}>>",
    "activity-series-v1": f"schema_version:string,window:struct<{_WINDOW},days:int>,source:struct<type:string,archive_coverage_complete:boolean,metadata_coverage_complete:boolean,coverage_complete:boolean,"
    f"hours_requested:bigint,hours_collected:bigint,watch_events_observed:bigint,repositories_seen:bigint,event_integrity:{_INTEGRITY},github_authenticated:boolean,github_rate_limit:{_RATES},"
    "metadata_selection:struct<method:string,minimum_daily_watch_events:bigint,minimum_window_watch_events:bigint,metadata_profile:string,selected:bigint,collected:bigint,collected_at:string>,"
    f"coverage_errors:array<{_PROBLEM}>>,days:array<struct<date:string,hours_requested:int,hours_collected:int,coverage_complete:boolean,watch_events_observed:bigint,event_integrity:{_INTEGRITY}>>,"
    "repositories:array<struct<full_name:string,watch_events_observed_total:bigint,observed_watch_velocity_per_day:double,first_seen_at:string,last_seen_at:string,"
    f"daily:array<struct<date:string,watch_events_observed:bigint,coverage_complete:boolean>>,metadata_selected:boolean,current:{_PROFILE}>>",
    "topic-analysis-v1": f"schema_version:string,observed_at:string,candidate_window:struct<{_WINDOW}>,methodology_version:string,source:struct<input_schema_version:string,candidate_schema_version:string,"
    f"classifier_kind:string,candidate_coverage_complete:boolean,candidate_coverage_errors:array<{_PROBLEM}>,github_authenticated:boolean,coverage_complete:boolean,"
    "coverage_errors:array<struct<source:string,target:string,status:int,message:string,code:string>>,"
    f"model_classification:struct<{_MODEL},transmitted_fields:array<string>,eligible:bigint,cache_hits:bigint,provider_decisions:bigint,invocations:bigint,failed:bigint,budget_exhausted:bigint,complete:boolean>>,"
    "keyword_census:struct<repositories_analyzed:bigint,repositories_with_observations:bigint,observation_records:bigint,unique_keywords:bigint,unique_classifier_evidence_keywords:bigint,"
    "keywords:array<struct<keyword_id:string,repository_count:bigint,occurrence_count:bigint,sources:array<string>>>>,"
    "repositories:array<struct<repository_id:bigint,full_name:string,ai_relevance:struct<score:double,decision:string,evidence:array<struct<keyword_id:string,source:string,contribution:double>>,"
    "model_evidence:string>,community_status:string,observations:array<struct<observed_at:string,repository_id:bigint,keyword_id:string,source:string,occurrence_count:bigint,confidence:double>>>>",
    "repository-lifecycle-v1": f"schema_version:string,generated_at:string,window:struct<{_WINDOW}>,methodology:struct<methodology_version:string,main_daily_watch_events:int,scout_weekly_watch_events:int,"
    "fast_breakout_weekly_watch_events:int,active_after_qualified_weeks:int,inactive_after_below_scout_weeks:int>,source:struct<input_schema_version:string,"
    f"input_snapshots:array<struct<file_name:string,{_WINDOW},days:int,archive_coverage_complete:boolean,integrity_verification:string>>,coverage_complete:boolean,integrity_verification:string>,"
    f"weeks:array<struct<{_WINDOW},{_COVERED},repositories_observed:bigint,main_radar_repositories:bigint,emerging_scout_repositories:bigint,fast_breakout_repositories:bigint>>,"
    "repositories:array<struct<repository_id:bigint,full_name:string,aliases:array<string>,availability_status:string,radar_status:string,first_observed_at:string,last_observed_at:string,"
    "first_detected_at:string,state_changed_at:string,last_qualified_week:string,consecutive_qualified_weeks:int,consecutive_below_scout_weeks:int,fast_breakout:boolean,breakout_status:string,"
    f"breakout_detected_at:string,weeks:array<struct<{_WINDOW},{_COVERED},weekly_watch_events:bigint,max_daily_watch_events:bigint,active_days:bigint,main_radar:boolean,emerging_scout:boolean,"
    "fast_breakout:boolean,radar_status:string,breakout_status:string,consecutive_qualified_weeks:int,consecutive_below_scout_weeks:int>>>>,"
    "events:array<struct<repository_id:bigint,full_name:string,type:string,effective_week:string,previous_status:string,next_status:string,reason:string>>",
    "city-v1": f"schema_version:string,generated_at:string,period:string,window:struct<{_WINDOW}>,methodology:struct<builder:string,district_assignment:string,community_assignment:string,ai_relevance:string,"
    "repository_lifecycle:string>,source:struct<activity_schema_version:string,analysis_schema_version:string,lifecycle_schema_version:string,activity_coverage_complete:boolean,"
    "analysis_coverage_complete:boolean,lifecycle_coverage_complete:boolean,coverage_complete:boolean,archive_coverage_complete:boolean,metadata_coverage_complete:boolean,repositories_considered:bigint,"
    f"ai_related_repositories:bigint,included_repositories:bigint,excluded_missing_metadata:bigint,metadata_collected_at:string,metadata_selection_rule:string,model_classification:struct<{_MODEL}>>,"
    "districts:array<struct<id:string,label:string,ko:string,color:string>>,"
    "communities:array<struct<id:string,label:string,district_id:string,status:string,repository_count:bigint,natural_building_count:bigint>>,"
    "repositories:array<struct<repository_id:bigint,full_name:string,url:string,description:string,detection_explanation:struct<methodology_version:string,label:string,summary:string,"
    "signals:struct<window_watch_events:bigint,max_daily_watch_events:bigint,active_days:bigint,selection_rule:string,archive_coverage_complete:boolean>>,district_id:string,community_id:string,"
    "global_rank:bigint,community_rank:bigint,ai_relevance:double,radar_status:string,availability_status:string,breakout_status:string,watch_events_window:bigint,weekly_watch_events:bigint,"
    "max_daily_watch_events:bigint,stars:bigint,forks:bigint,commits_30d:bigint,contributors_count:bigint,keywords:array<string>,flags:array<string>>>,"
    "edges:array<string>,community_edges:array<string>,display:struct<top_n_options:array<int>,mvp_visible_budget:int>",
}


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """path, schema_version and doc (VARIANT) of the JSON files in ``path``, one a row; what isn't JSON, or of no known version, fails the read."""
    if empty := [f for f in store.sizes(spark, path) if not f[1]]:  # Spark's readers leave empty files out
        raise ValueError(f"{empty[0][0]}: not JSON")
    files = spark.read.format("binaryFile").load(path).select("path", F.try_parse_json(F.decode("content", "UTF-8")).alias("doc"))
    refused = lambda what: F.raise_error(F.concat(F.col("path"), F.lit(what)))
    version = F.try_variant_get("doc", "$.schema_version", "string")
    checked = (
        F.when(F.col("doc").isNull(), refused(": not JSON").cast("string"))
        .when(version.isin(*SCHEMAS), version)
        .otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": unknown version "), F.coalesce(version, F.lit("none")))).cast("string"))
    )
    return files.select("path", checked.alias("schema_version"), "doc")


def of_version(documents: DataFrame, version: str) -> DataFrame:
    """The documents of one version with its declared columns, and their path."""
    chosen = documents.filter(F.col("schema_version") == version)
    return chosen.select("path", F.variant_get("doc", "$", f"struct<{SCHEMAS[version]}>").alias("d")).select("path", "d.*")


def read(spark: SparkSession, path: str, *versions: str) -> dict[str, DataFrame]:
    """The documents in ``path`` by version; with ``versions`` others than these are refused as well."""
    documents = parsed(spark, path)
    if versions:
        known = F.when(F.col("schema_version").isin(*versions), F.col("schema_version")).otherwise(
            F.raise_error(F.concat(F.col("path"), F.lit(f": expected {' or '.join(versions)}, found "), F.col("schema_version"))).cast("string")
        )
        documents = documents.withColumn("schema_version", known)
    return {v: of_version(documents, v) for v in versions or SCHEMAS}


def write(documents: DataFrame, folder: str, version: str, name: str = "name") -> None:
    """Each row as one JSON file, indented, named by its column ``name``; a file appears whole, and one that is there stays and is an error.

    Columns are those of the version, in its order; those that are missing are null. ``folder`` is a path for pyarrow's file systems.
    """
    spark = documents.sparkSession
    kind = spark.createDataFrame([], SCHEMAS[version]).schema
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in documents.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind if f.name != "schema_version"]
    shaped = documents.select(F.col(name).alias("name_"), F.struct(F.lit(version).alias("schema_version"), *columns).alias("d"))
    texts = shaped.select("name_", json_of(F.col("d"), kind, by_name=False).alias("text"))

    def put(frames):
        import pandas as pd
        from pyarrow import fs

        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for frame in frames:
            for own, text in zip(frame["name_"], frame["text"], strict=True):
                if store.get_file_info(f"{root}/{own}").type != fs.FileType.NotFound:
                    raise FileExistsError(f"{folder}/{own}")
                fresh = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(fresh) as out:
                    out.write((json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n").encode())
                store.move(fresh, f"{root}/{own}")
            yield pd.DataFrame({"name": frame["name_"]})

    texts.mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()


def listed(rows: DataFrame, columns: dict[str, Column], order: list[Column], name: str) -> DataFrame:
    """One row with the array ``name`` of ``rows`` as structs of ``columns`` (maps too), in ``order``, which must be total; more than LIMIT rows are an error."""
    placed = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    few = rows.select(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))).alias("o"), F.struct(*(c.alias(n) for n, c in columns.items())).alias("row")).limit(LIMIT + 1)
    sized = few.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "row")), placed), lambda x: x["row"]).alias(name))  # LIMIT rows at most
    return sized.select(F.when(F.size(name) <= LIMIT, F.col(name)).otherwise(F.raise_error(F.lit(f"more than {LIMIT} {name}"))).alias(name))
