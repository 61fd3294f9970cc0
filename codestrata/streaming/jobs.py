"""Jobs with leases as rows: every step of their life takes the tables before it and gives those after it.

A job row has ``id, projectId, type, payloadJson, status, progress, attemptCount, maxAttempts, lockedBy, leaseUntil,
heartbeatAt, createdAt, startedAt, finishedAt, errorMessage``. A step that another owner has overtaken changes nothing:
owners are told apart by who holds the job and by which try.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Seconds of a lease, and after which a job without one counts as stale.
LEASE, STALE = 30, 900


DEFAULT_ATTEMPTS = 3
# Project states from which a job of each type may start, the state it puts the project into and the one it ends in.
START_STATES = {"analyze": ("ready", "completed", "failed"), "import_zip": ("draft", "ready", "completed", "failed"), "import_git": ("draft", "ready", "completed", "failed")}
WORK_STATE = {"analyze": "analyzing", "import_zip": "importing", "import_git": "importing"}
END_STATE = {"analyze": "completed", "import_zip": "ready", "import_git": "ready"}
# Progress of a job at each of its stages.
PROGRESS = {"analyze": (5, 20, 45, 70, 85, 100), "import_zip": (10, 60, 80, 90, 100), "import_git": (10, 60, 80, 90, 100)}
PAYLOAD = "type string, zipContent string, tempFilePath string, originalFileName string, gitUrl string"


def _seconds(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))


def is_active() -> Column:
    return F.col("status").isin("queued", "running")


def is_lease_expired(now: Column) -> Column:
    """A running job whose lease is over, or that never had one."""
    return (F.col("status") == "running") & (F.col("leaseUntil").isNull() | (F.col("leaseUntil") <= now))


def is_blocking(now: Column) -> Column:
    """A job that keeps its project from getting another one."""
    return (F.col("status") == "queued") | ((F.col("status") == "running") & ~is_lease_expired(now))


def has_lease() -> Column:
    return F.col("leaseUntil").isNotNull()


def max_attempts() -> Column:
    return F.greatest(F.lit(1), F.coalesce("maxAttempts", F.lit(DEFAULT_ATTEMPTS)))


def can_retry() -> Column:
    return F.coalesce("attemptCount", F.lit(0)) < max_attempts()


def is_claimable(now: Column) -> Column:
    """Tries left, and queued, or running with an expired lease, or running without one for too long."""
    tries = F.coalesce("attemptCount", F.lit(0)) < F.coalesce("maxAttempts", F.lit(3))
    expired = F.col("leaseUntil") <= now
    stale = F.col("leaseUntil").isNull() & (F.coalesce("startedAt", "createdAt") <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(STALE)))
    return tries & ((F.col("status") == "queued") | ((F.col("status") == "running") & F.coalesce(expired | stale, F.lit(False))))


def next_claim(jobs: DataFrame, now: Column) -> DataFrame:
    """The job that would be claimed: the oldest claimable one by creation and id."""
    row = F.struct(*jobs.columns)
    return jobs.where(is_claimable(now)).agg(F.min_by(row, F.struct("createdAt", "id")).alias("j")).where("j IS NOT NULL").select("j.*")


def claimed(jobs: DataFrame, worker: str, now: Column) -> DataFrame:
    """The jobs after a worker has taken the next one: running, held by it, one try more, with a fresh lease."""
    mine = F.col("id") == F.col("_id")
    taken = jobs.crossJoin(F.broadcast(next_claim(jobs, now).select(F.col("id").alias("_id"))))  # one row or none
    new = {"status": F.lit("running"), "lockedBy": F.lit(worker), "attemptCount": F.coalesce("attemptCount", F.lit(0)) + 1, "leaseUntil": now + _seconds(LEASE), "heartbeatAt": now, "startedAt": F.coalesce("startedAt", now)}
    out = taken.select(*[F.when(mine, v).otherwise(F.col(c)).alias(c) if (v := new.get(c)) is not None else F.col(c) for c in jobs.columns])
    return out.unionByName(jobs.join(out.select("id"), "id", "left_anti"))


def _fenced(jobs: DataFrame, told: DataFrame) -> DataFrame:
    """Jobs with ``_own``: whether ``told(id, lockedBy, attemptCount, …)`` comes from who holds the job in this very try."""
    t = told.select("id", F.col("lockedBy").alias("_by"), F.col("attemptCount").alias("_try"), *[F.col(c).alias(f"_{c}") for c in told.columns if c not in ("id", "lockedBy", "attemptCount")])
    t = t.dropDuplicates(["id", "_by", "_try"])
    own = (F.col("status") == "running") & F.col("lockedBy").eqNullSafe(F.col("_by")) & F.col("attemptCount").eqNullSafe(F.col("_try"))
    held = jobs.join(t, "id", "left").withColumn("_own", F.coalesce(own, F.lit(False)))
    # of several reports on a job only the owner's counts; without one the row stays once
    return held.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.col("_own").desc()))).where("_n = 1").drop("_n", "_by", "_try")


def heartbeats(jobs: DataFrame, beats: DataFrame, now: Column) -> DataFrame:
    """Leases after ``beats(id, lockedBy, attemptCount)``: prolonged for owners whose lease has not run out."""
    alive = F.col("_own") & (F.col("leaseUntil") > now)
    new = {"leaseUntil": now + _seconds(LEASE), "heartbeatAt": now}
    return _fenced(jobs, beats).select(*[F.when(alive, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def finalized(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Jobs after ``results(id, lockedBy, attemptCount, status, errorMessage)``: completed or failed, and released."""
    of = {"status": F.col("_status"), "errorMessage": F.col("_errorMessage"), "finishedAt": now, "lockedBy": F.lit(None).cast("string"), "leaseUntil": F.lit(None).cast("timestamp"), "progress": F.when(F.col("_status") == "completed", 100).otherwise(F.col("progress"))}
    return _fenced(jobs, results).select(*[F.when(F.col("_own"), of[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in of else F.col(c) for c in jobs.columns])


def follow_ups(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(projectId, type, payloadJson)``: an analysis for every import that has just been completed."""
    done = after.where((F.col("status") == "completed") & F.col("type").isin("import_zip", "import_git")).join(before.where(F.col("status") == "running").select("id"), "id", "left_semi")
    return done.select("projectId", F.lit("analyze").alias("type"), F.lit('{"type":"analyze"}').alias("payloadJson")).distinct()


def project_states(projects: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Projects after jobs have ended: ready or completed; failed only those that are still in the work of that job."""
    ended = after.where(F.col("status").isin("completed", "failed")).join(before.where(is_active()).select("id"), "id", "left_semi")
    m = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("type")]
    last = ended.groupBy(F.col("projectId").alias("id")).agg(F.max_by(F.struct(F.col("status").alias("s"), m(WORK_STATE).alias("w"), m(END_STATE).alias("e")), "id").alias("j"))
    p = projects.join(last, "id", "left")
    working = F.col("status") == F.col("j.w")
    state = F.when(working & (F.col("j.s") == "completed"), F.col("j.e")).when(working & (F.col("j.s") == "failed"), "failed").otherwise(F.col("status"))
    return p.withColumn("status", state).select(*projects.columns)


def enqueued(jobs: DataFrame, projects: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """What becomes of ``requests(requestId, projectId, type, payloadJson)``: ``accepted``, or why not.

    A project takes one job at a time: a request fails while a job blocks it, and of several requests the
    first by id is taken. Its project must be in a state that the job may start from.
    """
    blocked = jobs.where(is_blocking(now)).select("projectId").distinct().withColumn("_blocked", F.lit(True))
    states = F.create_map(*[x for k, v in START_STATES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])[F.col("type")]
    first = F.row_number().over(W.partitionBy("projectId").orderBy("requestId"))
    r = requests.join(projects.select(F.col("id").alias("projectId"), F.col("status").alias("projectStatus")), "projectId", "left").join(blocked, "projectId", "left").withColumn("_first", first)
    p = F.from_json("payloadJson", PAYLOAD)
    why = (
        F.when(F.col("projectStatus").isNull(), "PROJECT_NOT_FOUND").when(~is_payload(p, F.col("type")), "INVALID_PAYLOAD").when(F.col("_blocked") | (F.col("_first") > 1), "PROJECT_JOB_ACTIVE")
        .when(~F.coalesce(F.array_contains(states, F.col("projectStatus")), F.lit(False)), "INVALID_PROJECT_STATE")
    )
    return r.select(*requests.columns, why.isNull().alias("accepted"), why.alias("reason"))


def is_payload(p: Column, kind: Column) -> Column:
    """Whether a parsed payload is one of its tagged forms and of the row's type."""
    text = lambda c: F.length(F.trim(F.coalesce(p[c], F.lit("")))) > 0
    one = F.when(p["type"] == "import_zip", text("zipContent") != text("tempFilePath")).when(p["type"] == "import_git", text("gitUrl")).when(p["type"] == "analyze", F.lit(True)).otherwise(F.lit(False))
    return F.coalesce(one & (p["type"] == kind), F.lit(False))


def parsed_payloads(jobs: DataFrame) -> DataFrame:
    """Jobs with their payload's fields, and ``validPayload``; the fields of an invalid one are null."""
    p = F.from_json("payloadJson", PAYLOAD)
    ok = is_payload(p, F.col("type"))
    return jobs.withColumn("validPayload", ok).select("*", *[F.when(ok, p[c]).alias(c) for c in ("zipContent", "tempFilePath", "originalFileName", "gitUrl")])


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease ran out, or that without one began too long ago, go back to the queue, or fail when their tries are used up."""
    none = lambda c: F.lit(None).cast(jobs.schema[c].dataType)
    expired = has_lease() & is_lease_expired(now)
    beat = F.col("heartbeatAt") if "heartbeatAt" in jobs.columns else F.lit(None)
    legacy = ~has_lease() & beat.isNull() & (F.col("startedAt").isNull() | (F.col("startedAt") <= now - _seconds(STALE)))
    out = (F.col("status") == "running") & F.coalesce(expired | legacy, F.lit(False))
    status = F.when(out & can_retry(), "queued").when(out, "failed").otherwise(F.col("status"))
    cleared = {c: F.when(out, none(c)).otherwise(F.col(c)) for c in ("lockedBy", "leaseUntil", "heartbeatAt") if c in jobs.columns}
    if "startedAt" in jobs.columns:
        cleared["startedAt"] = F.when(out & can_retry(), none("startedAt")).otherwise(F.col("startedAt"))
    return jobs.withColumn("_status", status).select(*[F.col("_status").alias(c) if c == "status" else cleared[c].alias(c) if c in cleared else F.col(c) for c in jobs.columns])


def orphaned_projects(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Projects that are importing or analyzing without an active job: they are to fail."""
    busy = jobs.where(is_active()).select(F.col("projectId").alias("id")).distinct()
    return projects.where(F.col("status").isin("importing", "analyzing")).join(busy, "id", "left_anti")


def expired_uploads(uploads: DataFrame, jobs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Temporary ``uploads(path, modifiedAt)`` that are old and that no active job refers to."""
    used = parsed_payloads(jobs.where(is_active())).select(F.col("tempFilePath").alias("path")).where(F.col("path").isNotNull()).distinct()
    return uploads.where(F.col("modifiedAt") <= now - _seconds(seconds)).join(used, "path", "left_anti")


def error_text(stage: Column, message: Column, *context: Column) -> Column:
    """``stage | message | context``; what is missing is left out."""
    return F.concat_ws(" | ", *[F.when(F.trim(c) != "", c) for c in (stage, message, *context)])


def progressed(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """Jobs after ``stages(id, lockedBy, attemptCount, stage)`` told by their owners: the progress of that stage, never less than before."""
    steps = F.create_map(*[x for k, v in PROGRESS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])[F.col("type")]
    now = F.greatest(F.coalesce("progress", F.lit(0)), F.coalesce(F.get(steps, F.col("_stage")), F.lit(0)))
    return _fenced(jobs, stages).select(*[F.when(F.col("_own"), now).otherwise(F.col(c)).alias(c) if c == "progress" else F.col(c) for c in jobs.columns])


def retry_delay(failures: Column) -> Column:
    """Milliseconds: half a second doubled with each failure, 30 s at most."""
    return F.least(F.lit(30_000), (F.lit(500) * F.pow(F.lit(2), F.least(failures - 1, F.lit(6)))).cast("int"))


# Allowed changes of a project's status.
TRANSITIONS = (
    ("draft", "importing"), ("draft", "failed"), ("importing", "ready"), ("importing", "failed"), ("ready", "importing"), ("ready", "analyzing"), ("ready", "failed"),
    ("analyzing", "completed"), ("analyzing", "failed"), ("completed", "importing"), ("completed", "analyzing"), ("completed", "failed"), ("failed", "importing"), ("failed", "analyzing"),
)


def applied_transitions(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Projects after ``changes(id, status)`` that the table allows; others leave them as they are."""
    c = projects.select("id", F.col("status").alias("before")).join(changes.select("id", F.col("status").alias("after")).dropDuplicates(["id"]), "id")
    fine = c.join(invalid_transitions(c).select("id"), "id", "left_anti").select("id", "after")
    return projects.join(fine, "id", "left").withColumn("status", F.coalesce("after", "status")).select(*projects.columns)


def invalid_transitions(changes: DataFrame) -> DataFrame:
    """Rows of ``(…, before, after)`` that the table does not allow; staying the same is allowed."""
    allowed = changes.sparkSession.createDataFrame(list(TRANSITIONS), "before string, after string")
    return changes.where(~F.col("before").eqNullSafe(F.col("after"))).join(F.broadcast(allowed), ["before", "after"], "left_anti")
