"""Plan lint: rows (plan_id, code, message, field) for what a plan lacks. Rules over nested rows are expressions; none leaves the JVM.

Only shapes of the free-form frontmatter are read on the executors' Python, as it was parsed there; here it is JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions import text

# Fixed values of the plan format.
REQUIRED = (
    "schema_version", "id", "title", "status", "created", "updated_at", "revision", "content_hash", "revision_type", "reapproval_required", "owner", "last_writer",
    "files", "symbols", "context_pages", "evidence", "change_control", "engineering", "testing", "approval",
)
SECTIONS = ("goal", "non-goals", "tasks", "validation", "testing strategy", "execution notes", "engineering requirements", "quality gates")
PLAN_STATUSES = ("draft", "approved", "executing", "blocked", "done", "cancelled")
TASK_STATUSES = ("pending", "in-progress", "blocked", "done", "skipped")
TASK_RISKS = ("low", "medium", "high")
BATCH_STATUSES = ("pending", "in-progress", "validating", "passed", "failed", "blocked", "skipped", "stale")
VAGUE = ("test it", "test", "tests", "verify", "verify it", "verify it works", "it works", "manual test")


def issue(test: Column, code: str, message: Column | str, field: Column | str) -> Column:
    """A struct where the test holds, else null."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), as_col(message).alias("message"), as_col(field).alias("field")))


def lint(plans: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """plan_id, path, code, message, field of every plan; ``files`` (path) are those that references may name."""
    broken = plans.where("code is not null").select("plan_id", "path", "code", "message", F.lit("frontmatter").alias("field"))
    good = plans.where("code is null")
    rules = _frontmatter() + _sections() + _workflow()
    each = [F.filter(F.array(*rules), lambda x: x.isNotNull()), _tasks(), _batches(), _conflicts(), _tests(), _gates()]
    found = good.select("plan_id", "path", F.inline(F.concat(*each))).unionByName(broken)
    twice = plans.where("code is null").groupBy("plan_id").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")
    found = found.unionByName(twice.select("plan_id", "path", F.lit("PLAN_ID_DUPLICATE").alias("code"), F.format_string("%d plans share this id", "n").alias("message"), F.lit("id").alias("field")))
    return found if files is None else found.unionByName(references(good, files))


def _key(name: str) -> Column:
    return F.get_json_object("frontmatter", f"$.{name}")


def _frontmatter() -> list[Column]:
    present = F.json_object_keys("frontmatter")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), present))
    whole = F.size(missing) == 0
    is_list = lambda name: F.coalesce(_key(name), F.lit("")).startswith("[")
    bad = lambda test, message, field: issue(whole & test, "PLAN_SCHEMA_INVALID", message, field)
    out = [issue(~whole, "PLAN_SCHEMA_INVALID", F.concat(F.lit("frontmatter lacks "), F.array_join(missing, ", ")), "frontmatter")]
    out += [
        bad(~_key("schema_version").eqNullSafe(F.lit("1")), "only schema version 1 is known", "schema_version"), bad(F.trim(F.coalesce(_key("id"), F.lit(""))) == "", "the plan needs an id", "id"),
        bad(~F.col("status").isin(*PLAN_STATUSES), F.concat(F.lit("unknown plan status "), "status"), "status"), bad(F.coalesce("revision", F.lit(0)) < 1, "revisions count from 1", "revision"),
        bad(F.trim(F.coalesce(_key("content_hash"), F.lit(""))) == "", "the content needs a digest", "content_hash"), bad(~F.coalesce(_key("revision_type"), F.lit("")).isin("semantic", "state"), "unknown revision type", "revision_type"),
        bad(~F.coalesce(_key("reapproval_required"), F.lit("")).isin("true", "false"), "expected true or false", "reapproval_required"),
        *[bad(~is_list(n), "expected a list", n) for n in ("files", "symbols", "context_pages", "evidence", "engineering.standards", "engineering.quality_gates", "testing.tests", "testing.manual_checks")],
        bad(~F.coalesce(_key("change_control.mode"), F.lit("")).isin("adaptive", "strict"), "expected adaptive or strict", "change_control.mode"),
        bad(~F.coalesce(_key("engineering.profile"), F.lit("")).isin("prototype", "product", "production"), "unknown profile", "engineering.profile"),
        bad(~F.coalesce(_key("engineering.architecture_style"), F.lit("")).isin("none", "layered", "modular-monolith", "event-driven", "plugin"), "unknown architecture style", "engineering.architecture_style"),
        bad(~F.coalesce(_key("engineering.plain_language"), F.lit("")).isin("true", "false"), "expected true or false", "engineering.plain_language"),
        bad(~F.coalesce(_key("testing.approach"), F.lit("")).isin("test-with-change", "reproduction-first", "test-after-with-reason"), "unknown testing approach", "testing.approach"),
    ]
    return out


def _sections() -> list[Column]:
    text_of = lambda n: F.coalesce(F.try_element_at("sections", F.lit(n)), F.lit(""))
    out = [issue(text_of(n) == "", "PLAN_SECTION_MISSING", f"there is no text under {n!r}", f"sections.{n}") for n in SECTIONS]
    out.append(issue(_key("engineering.profile").isin("product", "production") & (text_of("testing strategy") == ""), "PLAN_TESTING_STRATEGY_MISSING", "this profile needs a testing strategy", "sections"))
    return [*out, issue(F.size("tasks") == 0, "PLAN_TASKS_MISSING", "no task table was found", "tasks")]


def _workflow() -> list[Column]:
    has = lambda *names: F.exists("batches", lambda x: F.lower(x.status).isin(*names))
    return [
        issue((F.col("status") != "draft") & (_key("content_hash") == "pending"), "PLAN_CONTENT_HASH_PENDING", "beyond a draft the content digest must be known", "content_hash"),
        issue((F.col("status") != "draft") & (F.coalesce(_key("approval"), F.lit("")).isin("", "{}", "null", "[]")), "PLAN_SCHEMA_INVALID", F.concat(F.lit("nobody is on record as approving this plan, which is "), "status"), "approval"),
        issue((F.col("status") == "draft") & has("passed", "failed", "stale"), "INVALID_TRANSITION", "a draft has batches with results", "batches"),
        issue((F.col("status") == "approved") & has("in-progress", "validating", "stale"), "INVALID_TRANSITION", "batches are under way though execution has not begun", "batches"),
        issue((F.col("status") == "executing") & ~has("in-progress", "validating", "passed", "failed", "blocked", "stale"), "INVALID_TRANSITION", "execution has begun but no batch has", "batches"),
    ]


def _rows(column: str, make) -> Column:
    """Issues of every element of a nested table."""
    return F.flatten(F.transform(column, lambda t, i: F.filter(F.array(*make(t, i)), lambda x: x.isNotNull())))


def _tasks() -> Column:
    known = F.col("batches.batch")

    def make(t, i):
        number = t.number.cast("string")
        at = lambda f: F.concat(F.lit("tasks["), number, F.lit(f"].{f}"))
        plain = F.trim(F.regexp_replace(F.lower(F.coalesce(t.validation, F.lit(""))), "[^a-z0-9 ]+", " "))
        vague = (plain == "") | plain.isin(*VAGUE)
        return [
            issue(F.exists(F.slice("tasks", F.lit(1), i), lambda x: x.number == t.number), "PLAN_SCHEMA_INVALID", F.concat(F.lit("several tasks are number "), number), "tasks.#"),
            issue(~F.coalesce(t.status, F.lit("")).isin(*TASK_STATUSES), "PLAN_SCHEMA_INVALID", F.concat(F.lit("unknown task status "), F.coalesce(t.status, F.lit("None"))), at("status")),
            issue(~F.coalesce(t.risk, F.lit("")).isin(*TASK_RISKS), "PLAN_SCHEMA_INVALID", F.concat(F.lit("unknown risk "), F.coalesce(t.risk, F.lit("None"))), at("risk")),
            issue(t.batch == "", "PLAN_SCHEMA_INVALID", F.concat(F.lit("no batch for task "), number), at("batch")),
            issue((t.batch != "") & (F.size("batches") > 0) & ~F.array_contains(known, t.batch), "PLAN_SCHEMA_INVALID", F.concat(F.lit("no batch "), t.batch, F.lit(", which task "), number, F.lit(" names")), at("batch")),
            issue(vague, "PLAN_VAGUE_VALIDATION", F.concat(F.lit("how is task "), number, F.lit(" validated?")), at("validation")),
            issue(~vague & ~plain.rlike("gate|manual|artifact"), "PLAN_VAGUE_VALIDATION", F.concat(F.lit("validation of task "), number, F.lit(" names no gate and no artifact")), at("validation")),
        ]

    return _rows("tasks", make)


def _batches() -> Column:
    return _rows("batches", lambda x, _: [
        issue(x.batch == "", "PLAN_SCHEMA_INVALID", "a batch has no name", "batches.batch"),
        issue((x.status != "") & ~x.status.isin(*BATCH_STATUSES), "BATCH_STATE_INVALID", F.concat(F.lit("unknown batch status "), x.status), F.concat(F.lit("batches["), x.batch, F.lit("].status"))),
    ])


def _conflicts() -> Column:
    def make(x, _):
        own = F.filter("tasks", lambda t: t.batch == x.batch)
        field = F.concat(F.lit("batches["), x.batch, F.lit("].status"))
        return [
            issue((F.lower(x.status) == "passed") & F.exists(own, lambda t: ~F.coalesce(t.status, F.lit("")).isin("done", "skipped")), "PLAN_STATE_CONFLICT", F.concat(F.lit("tasks of the passed batch "), x.batch, F.lit(" are open")), field),
            issue((F.lower(x.status) == "pending") & F.exists(own, lambda t: F.coalesce(t.status, F.lit("")) == "done"), "PLAN_STATE_CONFLICT", F.concat(F.lit("tasks of batch "), x.batch, F.lit(" are done before it began")), field),
        ]

    return _rows("batches", make)


_TEST = "array<struct<test_id:string,disposition:string,files:array<string>,reason:string,gate_id:string,batch:string>>"
_GATE = "array<struct<id:string,kind:string,blocking:string,command:array<string>>>"


def _listed(name: str, shape: str) -> Column:
    return F.coalesce(F.from_json(_key(name), shape), F.array().cast(shape))


def _tests() -> Column:
    """The testing contract: what each named test has to say about itself."""
    tests, known = _listed("testing.tests", _TEST), F.coalesce(F.from_json(_key("engineering.quality_gates"), "array<string>"), F.array().cast("array<string>"))
    none = issue(_key("engineering.profile").isin("product", "production") & (F.size(tests) == 0) & F.coalesce(_key("testing.manual_checks"), F.lit("[]")).isin("[]", ""), "PLAN_TESTING_STRATEGY_MISSING", "this profile needs tests or manual checks", "testing.tests")
    checks = F.coalesce(F.from_json(_key("testing.manual_checks"), "array<struct<artifact:string>>"), F.array().cast("array<struct<artifact:string>>"))

    def make(t, i):
        at = lambda f: F.concat(F.lit("testing.tests["), F.coalesce(t.test_id, F.lit("")), F.lit(f"].{f}"))
        blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
        kind = F.coalesce(t.disposition, F.lit(""))
        return [
            issue(blank(t.test_id), "PLAN_SCHEMA_INVALID", "a test has no id", at("test_id")), issue(~blank(t.test_id) & F.exists(F.slice(tests, F.lit(1), i), lambda x: x.test_id == t.test_id), "PLAN_SCHEMA_INVALID", "several tests share this id", at("test_id")),
            issue(~kind.isin("implement", "reuse", "omit"), "PLAN_SCHEMA_INVALID", "unknown disposition", at("disposition")), issue(kind.isin("implement", "reuse") & (F.coalesce(F.size(t.files), F.lit(0)) < 1), "TEST_CONTRACT_MISMATCH", "the test names no file", at("files")),
            issue(kind.isin("reuse", "omit") & blank(t.reason), "TEST_CONTRACT_MISMATCH", "no reason is given", at("reason")), issue((kind == "implement") & ~F.array_contains(known, F.coalesce(t.gate_id, F.lit(""))), "TEST_CONTRACT_MISMATCH", "no such quality gate", at("gate_id")),
        ]

    manual = F.transform(checks, lambda c, i: issue(F.trim(F.coalesce(c.artifact, F.lit(""))) == "", "TEST_CONTRACT_MISMATCH", "the check leaves no artifact", F.concat(F.lit("testing.manual_checks["), i.cast("string"), F.lit("].artifact"))))
    return F.concat(F.filter(F.concat(F.array(none), manual), lambda x: x.isNotNull()), _rows(tests, make))


def _gates() -> Column:
    gates = _listed("engineering.gates", _GATE)

    def make(g, i):
        at = lambda f: F.concat(F.lit("engineering.gates."), F.coalesce(g.id, F.lit("")), F.lit(f".{f}"))
        return [
            issue(F.trim(F.coalesce(g.id, F.lit(""))) == "", "PLAN_SCHEMA_INVALID", "a gate has no id", at("id")), issue(F.exists(F.slice(gates, F.lit(1), i), lambda x: x.id == g.id), "PLAN_SCHEMA_INVALID", "several gates share this id", at("id")),
            issue(~F.coalesce(g.kind, F.lit("")).isin("command", "review", "manual"), "PLAN_SCHEMA_INVALID", "unknown kind of gate", at("kind")), issue(~F.coalesce(g.blocking, F.lit("")).isin("true", "false"), "PLAN_SCHEMA_INVALID", "expected true or false", at("blocking")),
            issue((g.kind == "command") & (F.coalesce(F.size(g.command), F.lit(0)) < 1), "GATE_COMMAND_INVALID", "a command gate needs an argument list", at("command")),
        ]

    return _rows(gates, make)


def references(plans: DataFrame, files: DataFrame) -> DataFrame:
    """References of plans and their tasks that are no path, or name no file."""
    own = plans.select("plan_id", "path", F.explode("files").alias("value"), F.lit("files").alias("field"))
    in_tasks = plans.select("plan_id", "path", F.explode("tasks").alias("t")).select("plan_id", "path", F.explode("t.files").alias("value"), F.concat(F.lit("tasks["), F.col("t.number").cast("string"), F.lit("].files")).alias("field"))
    each = own.unionByName(in_tasks).withColumn("clean", text.repo_path(F.col("value")))
    known = files.select(F.col("path").alias("clean"), F.lit(True).alias("known")).distinct()
    joined = each.join(known, "clean", "left").where("clean is null or known is null")
    code = F.when(F.col("clean").isNull(), "PLAN_SCHEMA_INVALID").otherwise("PLAN_FILE_NOT_FOUND")
    message = F.when(F.col("clean").isNull(), F.concat(F.lit("no path within the repository: "), "value")).otherwise(F.concat(F.lit("no such file: "), "clean"))
    return joined.select("plan_id", "path", code.alias("code"), message.alias("message"), "field")
