"""A labelled corpus made by rule: families x occurrences to records, without duplicates, split by family, and proven apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import code_columns as C
from quarrymill.functions import text as X
from quarrymill.operators import relational
from quarrymill.operators.stats import hash_draw
from quarrymill.plans import templates as T
from quarrymill.plans.scoring import ANALYSIS_FIELDS, PATCH_FIELDS, control_passes
from quarrymill.scratch import materialize

# Weakness, slug, ecosystem, text that repaired code must not hold, text that it must hold.
SPECS = [
    ('CWE-089', 'sql_injection', 'python-stdlib', 'execute(f', 'execute("SELECT'),
    ("CWE-078", "command_injection", "python-stdlib", "shell=True", "subprocess.run(["),
    ("CWE-022", "path_traversal", "python-stdlib", None, "relative_to(root)"),
    ("CWE-502", "unsafe_deserialization", "python-stdlib", "pickle.loads", "json.loads"),
    ("CWE-798", "hardcoded_credentials", "python-stdlib", "synthetic_training_token", "os.environ"),
    ("CWE-327", "weak_cryptography", "python-stdlib", "sha1(", "pbkdf2_hmac"),
    ("CWE-200", "sensitive_data_exposure", "python-stdlib", "password=%s", "login user=%s"),
    ("CWE-862", "missing_authorization", "python-stdlib", None, "PermissionError"),
    ("CWE-918", "ssrf", "python-stdlib", None, "allow_redirects=False"),
    ("CWE-400", "resource_consumption", "python-stdlib", None, "1_048_576"),
    ("CWE-079", "flask_jinja_xss", "flask-jinja", "Markup(", "escape("),
    ("CWE-079", "django_safe_string_xss", "django", "mark_safe(", "format_html("),
    ("CWE-094", "dynamic_code_injection", "python-stdlib", "return eval(", "ast.literal_eval"),
    ("CWE-295", "requests_tls_verification", "requests", "verify=False", "verify=True"),
    ("CWE-319", "cleartext_http_transport", "requests", "http://", "https://"),
    ("CWE-352", "flask_csrf_validation", "flask", None, "compare_digest"),
    ("CWE-434", "fastapi_upload_validation", "fastapi-starlette", None, "allowed_types"),
    ("CWE-601", "flask_open_redirect", "flask", None, "parsed.netloc"),
    ("CWE-611", "lxml_external_entity", "lxml", None, "resolve_entities=False"),
    ("CWE-209", "django_error_details", "django", "str(exc)", "request failed"),
    ("CWE-276", "insecure_file_permissions", "python-stdlib", "0o777", "0o600"),
    ("CWE-330", "insecure_random_token", "python-stdlib", "random.choice", "secrets.choice"),
    ("CWE-347", "pyjwt_signature_bypass", "pyjwt", "verify_signature", "algorithms=["),
    ("CWE-306", "fastapi_missing_authentication", "fastapi", None, "status_code=401"),
    ("CWE-915", "mass_assignment", "web-api", None, "allowed_fields"),
    ("CWE-1333", "regex_dos", "python-stdlib", None, "re.escape"),
    ("CWE-377", "insecure_temp_file", "python-stdlib", "/tmp/", "mkstemp"),
    ("CWE-312", "plaintext_password_storage", "python-stdlib", "write_text(password", "pbkdf2_hmac"),
    ("CWE-113", "http_response_splitting", "web-api", None, "invalid header value"),
    ('CWE-117', 'log_injection', 'logging', None, 'replace("\\n"'),
    ("CWE-1236", "csv_formula_injection", "csv-pandas", None, "dangerous_prefixes"),
    ("CWE-643", "lxml_xpath_injection", "lxml", "xpath = f", "$account"),
    ("CWE-090", "ldap_filter_injection", "ldap3", None, "escape_filter_chars"),
    ("CWE-502", "pyyaml_unsafe_load", "pyyaml", "yaml.load(", "yaml.safe_load"),
    ("CWE-089", "sqlalchemy_text_injection", "sqlalchemy", "text(f", ":account_id"),
    ('CWE-022', 'tarfile_path_traversal', 'python-stdlib', 'extractall(destination)', 'filter="data"'),
    ("CWE-918", "httpx_client_ssrf", "httpx-fastapi", None, "follow_redirects=False"),
    ("CWE-409", "zip_decompression_bomb", "python-stdlib", None, "total_size"),
    ("CWE-384", "flask_session_fixation", "flask", None, ".clear()"),
    ('CWE-942', 'starlette_permissive_cors', 'fastapi-starlette', 'allow_origins=["*"]', 'allow_origins=trusted_origins'),
    ("CWE-614", "flask_insecure_cookie", "flask", "secure=False", "httponly=True"),
    ("CWE-1336", "jinja_template_injection", "jinja2", "Template(", "{{ value }}"),
    ("CWE-943", "mongodb_operator_injection", "pymongo", "find_one(payload", "isinstance(username, str)"),
    ("CWE-639", "django_idor", "django", None, "owner_id="),
    ("CWE-489", "flask_debug_mode", "flask", "debug=True", "debug=False"),
    ("CWE-307", "login_rate_limit", "web-api", None, ".allow("),
    ("CWE-732", "s3_public_acl", "boto3", "public-read", "ServerSideEncryption"),
    ('CWE-502', 'celery_pickle_serializer', 'celery', 'task_serializer="pickle"', 'accept_content=["json"]'),
    ("CWE-078", "asyncio_command_injection", "asyncio", "create_subprocess_shell", "create_subprocess_exec"),
    ("CWE-345", "webhook_signature_validation", "web-api", None, "compare_digest"),
]
# Shapes of code and the split that each is for.
SHAPES = [
    *[("train", s) for s in (
        "function", "keyword_only", "service_method", "static_method", "callable_object", "guarded_function", "two_stage",
        "async_function", "class_method", "nested_handler", "branch_dispatch", "stateful_service",
    )],
    ("val", "module_dispatch"), ("test", "adapter_method"), ("holdout", "policy_factory"),
]
SPLITS = ["train", "val", "test", "holdout"]


SOURCE_LICENSE = "Apache-2.0"
SYSTEM = "You review Python code for security and answer with one JSON object and nothing else."


def specs(spark: SparkSession) -> DataFrame:
    """The weaknesses with their templates; repr columns are the control texts as Python literals."""
    by_slug = {t.slug: t for t in T.TEMPLATES}
    rows = []
    for i, (cwe, slug, ecosystem, forbidden, required) in enumerate(SPECS):
        t = by_slug[slug]
        literals = [None if x is None else repr(x) for x in (forbidden, required)]
        kind = slug.replace("_", " ")
        rows.append((cwe, slug, ecosystem, forbidden, required, i, *literals, kind, t.args, t.imports_before, t.imports_after, t.before, t.after, t.risk, t.repair))
    return spark.createDataFrame(
        rows,
        "cwe string, slug string, ecosystem string, forbidden_test_text string, required_test_text string, ord int, forbidden_repr string, "
        "required_repr string, vuln_type string, n_args int, imports_before string, imports_after string, before string, after string, risk string, repair string",
    )


def forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.shape, f.head, f.indent, f.tail, f.entry) for f in T.FORMS], "shape string, head string, width int, tail string, entry string")


def plan(spark: SparkSession) -> DataFrame:
    """Every spec in every shape, numbered: a small fixed table."""
    shapes = spark.createDataFrame([(*s, i) for i, s in enumerate(SHAPES)], "split string, shape string, shape_ord int")
    family = F.lower(F.concat_ws("-", "cwe", "slug", F.replace("ecosystem", F.lit("_"), F.lit("-")), "split", F.replace("shape", F.lit("_"), F.lit("-"))))
    return specs(spark).crossJoin(shapes).select((F.col("ord") * len(SHAPES) + F.col("shape_ord")).alias("plan_ord"), family.alias("family"), "cwe", "slug", "ecosystem", "split", "shape", "forbidden_test_text", "required_test_text")


def task_of(occurrence: Column) -> tuple[Column, Column]:
    """Task and label by occurrence within a family: 4 of 10 repairs, 2 detections of each kind, 2 patches."""
    turn = F.pmod(occurrence, F.lit(10))
    return F.when(turn < 4, "repair").when(turn < 8, "detect").otherwise("repo_patch"), ~((turn >= 6) & (turn < 8))


def _fill(text: Column, marks: dict[str, Column]) -> Column:
    for mark, value in marks.items():
        text = F.replace(text, F.lit(f"@{mark}@"), value)
    return text


def _indented(body: Column, width: Column) -> Column:
    return F.array_join(F.transform(F.split(body, "\n"), lambda x: F.when(x != "", F.concat(F.repeat(F.lit(" "), width), x)).otherwise(x)), "\n")


def wrap(imports: Column, body: Column, marks: dict[str, Column]) -> Column:
    """A body in its form (columns head, width, tail), imports first."""
    top = F.when(imports != "", F.concat(imports, F.lit("\n\n\n"))).otherwise("")
    return _fill(F.concat(top, F.col("head"), _indented(body, F.col("width")), F.lit("\n"), F.col("tail")), marks)


def names(draw: Column, occurrence: Column) -> dict[str, Column]:
    """Names of function, class and arguments, and a number, all from one draw and the occurrence."""
    word = lambda words, shift: F.element_at(F.array(*map(F.lit, words)), (F.shiftright(draw, shift) % len(words) + 1).cast("int"))
    mark = F.lower(F.lpad(F.hex(draw % (1 << 40)), 10, "0"))
    title = F.replace(F.initcap(F.replace("slug", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    args = [F.concat_ws("_", word(nouns, 8 + 6 * i), F.substring(mark, 1 + 3 * i, 3)) for i, nouns in enumerate(T.NOUNS)]
    joined = F.array_join(F.slice(F.array(*args), 1, F.col("n_args")), ", ")
    return {
        "args": joined, "def": F.concat_ws("_", word(T.VERBS, 2), "slug", mark), "class": F.concat(word(T.KINDS, 5), title, F.upper(F.substring(mark, 1, 4))),
        "a": args[0], "b": args[1], "c": args[2], "n": (draw % 89 + 10 + occurrence).cast("string"),
    }


def safe_test(entry: Column, mark: Column) -> Column:
    """Source of a test that looks for the control in the code's own source."""
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("def test_"), "slug", F.lit("_"), mark, F.lit("():")), F.lit("    import inspect"), F.concat(F.lit("    shown = inspect.getsource("), entry, F.lit(")")),
            F.concat(F.lit("    assert "), "forbidden_repr", F.lit(" not in shown")), F.concat(F.lit("    assert "), "required_repr", F.lit(" in shown")),
        )
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def records(indexed: DataFrame, seed: int, *kept: str) -> DataFrame:
    """Rows (idx, attempt, and columns to keep) to records. All of a record follows from seed, family, occurrence and attempt."""
    spark = indexed.sparkSession
    n = len(SPECS) * len(SHAPES)
    rows = indexed.withColumn("plan_ord", F.pmod("idx", F.lit(n)).cast("int")).join(F.broadcast(plan(spark)), "plan_ord")  # 750 rows, fixed
    text = specs(spark).drop("cwe", "ecosystem", "forbidden_test_text", "required_test_text", "ord")
    rows = rows.join(F.broadcast(text), "slug").join(F.broadcast(forms(spark)), "shape").withColumn("occurrence", F.expr(f"idx div {n}"))  # 50 and 15 rows
    key = [F.lit(seed), F.col("family"), F.col("occurrence"), F.col("attempt")]
    rows = rows.withColumn("_draw", hash_draw(*key))
    marks = names(F.col("_draw"), F.col("occurrence"))
    task, positive = task_of(F.col("occurrence"))
    fixed = wrap(F.col("imports_after"), F.col("after"), marks)
    rid = X.record_id(F.col("cwe"), F.lit(seed), *key[1:])
    clean = F.concat(F.lit("Nothing to find for "), "cwe", F.lit(": the control that is needed is there."))
    made = rows.withColumns(
        {
            "id": rid, "task": task, "is_vulnerable": positive, "fixed_code": fixed,
            "vulnerable_code": F.when(positive, wrap(F.col("imports_before"), F.col("before"), marks)).otherwise(fixed),
            "explanation": F.when(positive, F.col("risk")).otherwise(clean), "patch_summary": F.when(positive, F.col("repair")).otherwise("The code stays as it is."),
            "safe_test": safe_test(_fill(F.col("entry"), marks), F.substring(F.substring_index(rid, "-", -1), 1, 8)),
        }
    )
    return made.select(
        "idx", "attempt", "id", "family", "split", F.lit("python").alias("language"), "cwe", "vuln_type", "ecosystem", "task", "is_vulnerable",
        "vulnerable_code", "fixed_code", "explanation", "patch_summary", "safe_test", "forbidden_test_text", "required_test_text", *kept,
    )


def build(spark: SparkSession, count: int, seed: int = 42, attempts: int = 100) -> DataFrame:
    """`count` records, no two with the same pair of token forms."""
    if count < len(SPECS) * len(SHAPES):
        raise ValueError("fewer records than families")
    return build_from(spark.range(count).select(F.col("id").alias("idx")), seed, attempts)


#: Records of a task at most: few bytes say which record it is, and some kilobytes and several parses follow from them.
TASK_RECORDS = 20_000


def _spread(indexed: DataFrame) -> DataFrame:
    """Rows by idx over tasks of TASK_RECORDS at most, and over all tasks that the session has."""
    n = max(int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-indexed.count() // TASK_RECORDS))
    return indexed.repartition(n, "idx")


def build_from(indexed: DataFrame, seed: int = 42, attempts: int = 100) -> DataFrame:
    """A record for each idx, no two with the same pair of token forms. A record that repeats an earlier pair is made again.

    Records follow from idx and attempt, so that only these and pairs' digests are written, shuffled and compared; whole
    records are made anew where they are used, and pass through a task one by one.
    """
    held, todo = None, indexed.select("idx", F.lit(0).alias("attempt"))
    for attempt in range(attempts):
        pair = F.sha2(F.concat_ws("\0", C.norm_code("vulnerable_code"), C.norm_code("fixed_code")), 256)
        made = materialize(records(_spread(todo), seed).select("idx", "attempt", pair.alias("pair_sha256")), "pairs")
        every = made if held is None else held.unionByName(made)
        first = every.groupBy("pair_sha256").agg(F.min("idx").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        met = materialize(every.join(first, "pair_sha256").select("idx", "_first"), "met")  # of pairs that repeat
        if met.where("idx = _first").groupBy("idx").count().where("count > 1").limit(1).count():  # an idx stands twice
            return build_from(indexed.select("idx").distinct(), seed, attempts)
        lost = met.where("idx <> _first").select("idx")
        if not lost.limit(1).count():
            return records(_spread(every), seed, "pair_sha256")
        held = materialize(every.join(lost, "idx", "left_anti"), "held")
        todo = lost.select("idx", F.lit(attempt + 1).alias("attempt"))
    raise ValueError("records repeat after all attempts")


def features(built: DataFrame) -> DataFrame:
    """Patch, changed lines, and digests of token and structure forms of each record. Clean records have no patch and no lines."""
    sha = lambda c: F.sha2(c, 256)
    return built.withColumns(
        {"patch": F.when(F.col("is_vulnerable"), C.make_patch("vulnerable_code", "fixed_code")).otherwise(""),
         "vulnerable_lines": C.vulnerable_lines("vulnerable_code", "fixed_code"),
         "vulnerable_sha256": sha(C.norm_code("vulnerable_code")), "fixed_sha256": sha(C.norm_code("fixed_code")),
         "vulnerable_structure_sha256": sha(C.struct_code("vulnerable_code")), "fixed_structure_sha256": sha(C.struct_code("fixed_code"))}
    )


# Conversations ------------------------------------------------------------------------------------------------------------


def analysis_target() -> Column:
    """The eight fields of an analysis, as compact JSON in their order."""
    return F.to_json(F.struct(*ANALYSIS_FIELDS), {"ignoreNullFields": "false"})


def patch_target() -> Column:
    return F.to_json(F.struct(finding_id().alias("finding_id"), F.col("patch_summary").alias("summary"), "patch"))


def finding_id() -> Column:
    return F.concat(F.lit("synthetic-"), "id")


def template_prompt() -> Column:
    """What is asked, by task, of a record's code."""
    keys = ", ".join(ANALYSIS_FIELDS)
    ask = {
        "repo_patch": F.concat(
            F.lit("Repair one finding in a repository. Answer with a JSON object that has the text keys finding_id, summary and patch and no other; "
                  "the patch is the smallest unified diff from the repository's root and changes app.py only.\n\nFinding "),
            finding_id(), F.lit(" ("), "cwe", F.lit("): "), "explanation", F.lit("\n\napp.py:\n"), "vulnerable_code",
        ),
        "detect": F.concat(
            F.lit("Say whether this Python code is vulnerable and where. Code that is defended already is clean and stays as it is. "
                  f"Answer with a JSON object that has the keys {keys} and no other.\n\nCode:\n"), "vulnerable_code",
        ),
    }
    repair = F.concat(
        F.lit(f"Find and repair the weakness of this Python code and change nothing else. Answer with a JSON object that has the keys {keys} and no other.\n\nCode:\n"), "vulnerable_code"
    )
    out = repair
    for task, text in ask.items():
        out = F.when(F.col("task") == task, text).otherwise(out)
    return out


def prompt_of(stored: Column) -> Column:
    """A record's own prompt, or the template's where it has none."""
    return F.coalesce(F.nullif(stored, F.lit("")), template_prompt())


def converse(featured: DataFrame) -> DataFrame:
    """featured with prompt, target and messages (system, user, assistant), by task."""
    patching = F.col("task") == "repo_patch"
    said = featured.withColumn("target", F.when(patching, patch_target()).otherwise(analysis_target())).withColumn("prompt", template_prompt())
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return said.withColumn("messages", F.array(turn("system", F.lit(SYSTEM)), turn("user", F.col("prompt")), turn("assistant", F.col("target"))))


def finish(featured: DataFrame) -> DataFrame:
    """Whole records, as they are written: conversation, what was verified, source and license."""
    again = C.apply_patch("vulnerable_code", "patch")
    talked = converse(featured).withColumn("_again", again)
    spec = F.struct("forbidden_test_text", "required_test_text")
    checks = F.struct(
        C.py_parses("vulnerable_code").alias("vulnerable_ast_parse"), C.py_parses("fixed_code").alias("fixed_ast_parse"), C.py_parses("safe_test").alias("safe_test_ast_parse"),
        control_passes(F.col("fixed_code"), spec).alias("security_oracle_pass"), (F.col("is_vulnerable") & F.coalesce(F.col("_again.text") == F.col("fixed_code"), F.lit(False))).alias("patch_round_trip"),
        F.when(F.col("task") == "repo_patch", "agent-v1").otherwise("analysis-v1").alias("target_schema"),
    )
    return talked.withColumns({"verification": checks, "source": F.lit("generated"), "source_license": F.lit(SOURCE_LICENSE)}).drop("_again")


RULES = ("parses", "control", "round_trip", "lines", "target", "roles")


def self_check(finished: DataFrame) -> DataFrame:
    """id and rule of records that break a rule of their making."""
    from quarrymill.sources.readers import violations

    v = F.col("verification")
    kinds = F.when(F.col("task") == "repo_patch", X.has_schema(F.col("target"), PATCH_FIELDS)).otherwise(X.has_schema(F.col("target"), ANALYSIS_FIELDS))
    roles = F.transform("messages", lambda m: m["role"]) == F.array(*map(F.lit, ("system", "user", "assistant")))
    rules = {
        "parses": ~(v["vulnerable_ast_parse"] & v["fixed_ast_parse"] & v["safe_test_ast_parse"]), "control": ~v["security_oracle_pass"],
        "round_trip": v["patch_round_trip"] != F.col("is_vulnerable"), "lines": (F.size("vulnerable_lines") > 0) != F.col("is_vulnerable"), "target": ~kinds, "roles": ~roles,
    }
    return violations(finished, "id", rules)


def gate(featured: DataFrame) -> DataFrame:
    """One row: what splits share of families, of pairs' token forms and of pairs' structures; passed if nothing."""
    pair = lambda kind: F.concat_ws(":", f"vulnerable_{kind}", f"fixed_{kind}")
    rows = featured.select("split", "family", pair("sha256").alias("pair"), pair("structure_sha256").alias("structure"))
    out = None
    for v in ("family", "pair", "structure"):
        shared = relational.group_overlaps(rows, "split", v, SPLITS).agg(F.sum("shared").alias(f"shared_{v}"))
        out = shared if out is None else out.join(F.broadcast(shared))  # one row each
    return out.withColumn("passed", F.expr("shared_family + shared_pair + shared_structure = 0"))


def hash_manifest(featured: DataFrame) -> DataFrame:
    """Digests of each record, for a manifest in order of id."""
    return featured.select("id", "split", "family", "vulnerable_sha256", "fixed_sha256", "vulnerable_structure_sha256", "fixed_structure_sha256")


def statistics(built: DataFrame) -> DataFrame:
    """Counts by split, weakness, both, task and split x task, in one pass."""
    sets = [["split"], ["cwe"], ["split", "cwe"], ["task"], ["split", "task"], ["ecosystem"]]
    return built.groupingSets(sets, "split", "cwe", "task", "ecosystem").agg(F.count("*").alias("n"), F.count_if("is_vulnerable").alias("n_vulnerable"), F.countDistinct("family").alias("families"))
