"""Code templates: for each weakness a body that has it and one that does not, and the forms that bodies are put in.

A body is text with the markers @a@, @b@, @c@ (arguments) and @n@ (a number that varies); a form has @def@ (the function's
name), @class@ (the class's) and @args@. Markers are replaced by column functions, so that records are made where the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """What one weakness looks like before and after its repair, and how both are told."""

    slug: str
    args: int
    imports_before: str
    imports_after: str
    before: str
    after: str
    risk: str
    repair: str


def _t(slug: str, args: int, imports_before: str, before: str, imports_after: str, after: str, risk: str, repair: str) -> Template:
    text = lambda x: x.strip("\n")
    return Template(slug, args, text(imports_before), text(imports_after), text(before), text(after), risk, repair)


TEMPLATES = (
    _t("sql_injection", 2, "", '''
statement = f"SELECT name, total FROM ledger_@n@ WHERE account = '{@b@}'"
cursor = @a@.cursor()
cursor.execute(f"{statement} ORDER BY name")
return cursor.fetchall()
''', "", '''
cursor = @a@.cursor()
cursor.execute("SELECT name, total FROM ledger_@n@ WHERE account = ? ORDER BY name", (@b@,))
return cursor.fetchall()
''', "A value from outside becomes part of the statement's text.", "Bind the value as a parameter of the statement."),
    _t("command_injection", 2, "import subprocess", '''
line = "gzip --keep --level @n@ " + @a@ + " > " + @b@
return subprocess.run(line, shell=True, check=False).returncode
''', "import subprocess", '''
with open(@b@, "wb") as target:
    done = subprocess.run(["gzip", "--stdout", "--keep", @a@], stdout=target, check=False)
return done.returncode
''', "A shell reads names from outside as part of a command.", "Pass the command as a list, without a shell."),
    _t("path_traversal", 2, "from pathlib import Path", '''
wanted = Path(@a@).joinpath(@b@)
return wanted.read_bytes()
''', "from pathlib import Path", '''
root = Path(@a@).resolve(strict=True)
wanted = root.joinpath(@b@).resolve()
wanted.relative_to(root)
return wanted.read_bytes()
''', "A name with parent folders leads out of the folder that may be read.", "Resolve the path and require that it lies below the root."),
    _t("unsafe_deserialization", 1, "import pickle", '''
state = pickle.loads(@a@)
return dict(state, version=@n@)
''', "import json", '''
state = json.loads(@a@)
return dict(state, version=@n@)
''', "Unpickling bytes from outside can run code.", "Read a data-only format."),
    _t("hardcoded_credentials", 1, "", '''
bearer = "synthetic_training_token_@n@"
@a@.headers["Authorization"] = "Bearer " + bearer
return @a@
''', "import os", '''
bearer = os.environ["UPSTREAM_TOKEN"]
@a@.headers["Authorization"] = "Bearer " + bearer
return @a@
''', "A credential stands in the source.", "Take the credential from the environment."),
    _t("weak_cryptography", 2, "import hashlib", '''
digest = hashlib.sha1(@b@ + @a@)
return digest.hexdigest()
''', "import hashlib", '''
digest = hashlib.pbkdf2_hmac("sha512", @a@, @b@, 310000 + @n@)
return digest.hex()
''', "A fast, broken digest protects a secret.", "Derive the digest slowly, with a salt."),
    _t("sensitive_data_exposure", 3, "", '''
@a@.warning("sign-in of %s password=%s", @b@, @c@)
return @b@
''', "", '''
@a@.warning("login user=%s", @b@)
return @b@
''', "A password is written to a log.", "Log who signs in and nothing secret."),
    _t("missing_authorization", 2, "", '''
@b@.archived = True
@b@.save()
return @b@
''', "", '''
if @b@.team_id not in @a@.team_ids:
    raise PermissionError("the record belongs to another team")
@b@.archived = True
@b@.save()
return @b@
''', "Anybody can change anybody's record.", "Require that the caller may change the record."),
    _t("ssrf", 2, "import requests", '''
answer = requests.get(@a@, timeout=@n@)
return answer.content
''', "import requests\nfrom urllib.parse import urlsplit", '''
parts = urlsplit(@a@)
if parts.scheme != "https" or parts.hostname not in @b@:
    raise ValueError("this host may not be asked")
answer = requests.get(@a@, timeout=@n@, allow_redirects=False)
return answer.content
''', "The server fetches whatever address it is given.", "Allow listed hosts only and follow no redirects."),
    _t("resource_consumption", 1, "", '''
chunks = []
while chunk := @a@.read(65536):
    chunks.append(chunk)
return b"".join(chunks)
''', "", '''
left = 1_048_576
chunks = []
while chunk := @a@.read(min(65536, left + 1)):
    left -= len(chunk)
    if left < 0:
        raise ValueError("more than a mebibyte was sent")
    chunks.append(chunk)
return b"".join(chunks)
''', "Input of any size is held in memory.", "Stop beyond a fixed size."),
    _t("flask_jinja_xss", 1, "from markupsafe import Markup", '''
shown = Markup("<li>%s</li>" % @a@)
return {"row": @n@, "html": shown}
''', "from markupsafe import escape", '''
shown = "<li>" + escape(@a@) + "</li>"
return {"row": @n@, "html": shown}
''', "Text from outside is marked as markup.", "Escape the text."),
    _t("django_safe_string_xss", 2, "from django.utils.safestring import mark_safe", '''
link = "<a href='/u/" + str(@a@) + "'>" + @b@ + "</a>"
return mark_safe(link)
''', "from django.utils.html import format_html", '''
return format_html("<a href='/u/{}'>{}</a>", @a@, @b@)
''', "A string put together from outside input is declared safe.", "Let the formatter escape its arguments."),
    _t("dynamic_code_injection", 1, "", '''
scope = {"limit": @n@}
return eval(@a@, scope)
''', "import ast", '''
if len(@a@) > 4096:
    raise ValueError("the literal is too long")
return ast.literal_eval(@a@)
''', "An expression from outside is run.", "Read literals only."),
    _t("requests_tls_verification", 2, "import requests", '''
session = requests.Session()
return session.put(@a@, data=@b@, verify=False, timeout=@n@)
''', "import requests", '''
session = requests.Session()
return session.put(@a@, data=@b@, verify=True, timeout=@n@)
''', "Certificates are not checked.", "Check certificates."),
    _t("cleartext_http_transport", 1, "import requests", '''
endpoint = "http://metrics.internal.example/ingest/@n@"
return requests.post(endpoint, json=@a@, timeout=10)
''', "import requests", '''
endpoint = "https://metrics.internal.example/ingest/@n@"
return requests.post(endpoint, json=@a@, timeout=10)
''', "Data travels unencrypted.", "Use an encrypted transport."),
    _t("flask_csrf_validation", 2, "", '''
chosen = @a@.form.get("plan", "basic")
@b@["plan"] = chosen
return chosen
''', "from hmac import compare_digest", '''
sent, known = @a@.form.get("csrf", ""), @b@.get("csrf", "")
if not known or not compare_digest(sent, known):
    raise PermissionError("the form was not made by this site")
chosen = @a@.form.get("plan", "basic")
@b@["plan"] = chosen
return chosen
''', "A form is accepted from any site.", "Compare the form's token with the session's."),
    _t("fastapi_upload_validation", 1, "", '''
return {"stored_as": @a@.filename, "slot": @n@}
''', "from uuid import uuid4", '''
allowed_types = {"image/png": ".png", "application/pdf": ".pdf"}
ending = allowed_types.get(@a@.content_type)
if ending is None:
    raise ValueError("files of this type are not taken")
if @a@.size is None or @a@.size > 2000000:
    raise ValueError("the file is too large")
return {"stored_as": uuid4().hex + ending, "slot": @n@}
''', "Uploads of any type, size and name are taken.", "Check type and size and choose the name."),
    _t("flask_open_redirect", 1, "from flask import redirect", '''
return redirect(@a@, code=302)
''', "from flask import redirect\nfrom urllib.parse import urlsplit", '''
parsed = urlsplit(@a@)
if parsed.netloc or parsed.scheme or @a@.startswith("//"):
    raise ValueError("the address leads to another site")
return redirect(@a@, code=302)
''', "Visitors are sent wherever a parameter says.", "Redirect within the site only."),
    _t("lxml_external_entity", 1, "from lxml import etree", '''
reader = etree.XMLParser(huge_tree=True)
return etree.XML(@a@, reader)
''', "from lxml import etree", '''
reader = etree.XMLParser(resolve_entities=False, no_network=True)
return etree.XML(@a@, reader)
''', "Entities of a document from outside are resolved.", "Resolve no entities and load nothing."),
    _t("django_error_details", 2, "from django.http import JsonResponse", '''
try:
    return JsonResponse({"value": @a@(@n@)})
except Exception as exc:
    return JsonResponse({"detail": str(exc)}, status=500)
''', "from django.http import JsonResponse", '''
try:
    return JsonResponse({"value": @a@(@n@)})
except Exception:
    @b@.exception("request failed")
    return JsonResponse({"detail": "request failed"}, status=500)
''', "Internal errors are shown to callers.", "Log the error and answer in general terms."),
    _t("insecure_file_permissions", 2, "import os", '''
handle = os.open(@a@, os.O_CREAT | os.O_WRONLY, 0o777)
with os.fdopen(handle, "w") as target:
    target.write(@b@)
return @a@
''', "import os", '''
handle = os.open(@a@, os.O_CREAT | os.O_WRONLY, 0o600)
with os.fdopen(handle, "w") as target:
    target.write(@b@)
return @a@
''', "Every user can read and change the file.", "Let the owner alone use the file."),
    _t("insecure_random_token", 1, "import random", '''
digits = "0123456789abcdef"
return @a@ + "".join(random.choice(digits) for _ in range(24))
''', "import secrets", '''
digits = "0123456789abcdef"
return @a@ + "".join(secrets.choice(digits) for _ in range(40))
''', "A token can be foretold.", "Draw the token from a secure source."),
    _t("pyjwt_signature_bypass", 3, "import jwt", '''
claims = jwt.decode(@a@, @b@, options={"verify_signature": False})
return claims.get("sub", @c@)
''', "import jwt", '''
claims = jwt.decode(@a@, @b@, algorithms=["RS256"], options={"require": ["exp", "sub"]})
return claims.get("sub", @c@)
''', "A token is believed without its signature.", "Check the signature with a fixed algorithm."),
    _t("fastapi_missing_authentication", 2, "", '''
rows = @b@.monthly_totals(@n@)
return {"rows": rows}
''', "from fastapi import HTTPException", '''
if not getattr(@a@, "is_authenticated", False):
    raise HTTPException(status_code=401, detail="sign in first")
rows = @b@.monthly_totals(@n@)
return {"rows": rows}
''', "A private report is open to all.", "Require a signed-in user."),
    _t("mass_assignment", 2, "", '''
@a@.__dict__.update(@b@)
@a@.save()
return @a@
''', "", '''
allowed_fields = ("nickname", "language", "time_zone")
for field in allowed_fields:
    if field in @b@:
        setattr(@a@, field, @b@[field])
@a@.save()
return @a@
''', "Callers can set every field of a record.", "Set listed fields only."),
    _t("regex_dos", 2, "import re", '''
return re.findall(@a@, @b@)[:@n@]
''', "import re", '''
if len(@a@) > 200:
    raise ValueError("the search text is too long")
return re.findall(re.escape(@a@), @b@)[:@n@]
''', "A pattern from outside can take time without end.", "Take the text literally and bound its length."),
    _t("insecure_temp_file", 1, "", '''
place = "/tmp/export-@n@.csv"
with open(place, "w") as target:
    target.write(@a@)
return place
''', "import os\nimport tempfile", '''
handle, place = tempfile.mkstemp(suffix=".csv")
with os.fdopen(handle, "w") as target:
    target.write(@a@)
return place
''', "A file's name in a shared folder is known beforehand.", "Let the system make a private file."),
    _t("plaintext_password_storage", 3, "from pathlib import Path", '''
password = @b@
entry = Path(@a@) / str(@c@)
return entry.write_text(password)
''', "import hashlib\nfrom pathlib import Path", '''
salt = str(@c@).encode().ljust(16, b".")
stored = hashlib.pbkdf2_hmac("sha256", @b@.encode(), salt, 400000 + @n@)
entry = Path(@a@) / str(@c@)
return entry.write_text(stored.hex())
''', "A password is kept as it is.", "Keep a slow, salted digest."),
    _t("http_response_splitting", 2, "", '''
@a@.headers["X-Trace"] = @b@
return @a@
''', "", '''
if any(mark in @b@ for mark in ("\\r", "\\n", "\\0")):
    raise ValueError("invalid header value")
@a@.headers["X-Trace"] = @b@
return @a@
''', "Line breaks in a header's value start other headers.", "Refuse control characters."),
    _t("log_injection", 2, "", '''
@a@.info("search for " + @b@)
return len(@b@)
''', "", '''
shown = @b@.replace("\\r", "\\\\r").replace("\\n", "\\\\n")
@a@.info("search for %s", shown)
return len(@b@)
''', "Line breaks in a value forge log lines.", "Escape line breaks before logging."),
    _t("csv_formula_injection", 2, "import csv", '''
out = csv.writer(@a@, delimiter=";")
out.writerow([str(x) for x in @b@])
return out
''', "import csv", '''
dangerous_prefixes = ("=", "+", "-", "@", "\\t")
cells = [str(x) for x in @b@]
cells = ["'" + x if x.startswith(dangerous_prefixes) else x for x in cells]
out = csv.writer(@a@, delimiter=";")
out.writerow(cells)
return out
''', "A cell can be run as a formula.", "Quote cells that look like formulas."),
    _t("lxml_xpath_injection", 2, "", '''
xpath = f"//account[@id='{@b@}']/balance"
found = @a@.xpath(xpath)
return found[:@n@]
''', "", '''
found = @a@.xpath("//account[@id=$account]/balance", account=@b@)
return found[:@n@]
''', "A value from outside becomes part of a path expression.", "Pass the value as a variable."),
    _t("ldap_filter_injection", 2, "", '''
query = "(&(objectClass=person)(mail=" + @b@ + "))"
return @a@.search("ou=staff", query, size_limit=@n@)
''', "from ldap3.utils.conv import escape_filter_chars", '''
query = "(&(objectClass=person)(mail=" + escape_filter_chars(@b@) + "))"
return @a@.search("ou=staff", query, size_limit=@n@)
''', "A value from outside becomes part of a filter.", "Escape the value."),
    _t("pyyaml_unsafe_load", 1, "import yaml", '''
settings = yaml.load(@a@, Loader=yaml.UnsafeLoader)
return settings or {}
''', "import yaml", '''
settings = yaml.safe_load(@a@)
return settings or {}
''', "Loading can make any object.", "Load plain data only."),
    _t("sqlalchemy_text_injection", 2, "from sqlalchemy import text", '''
rows = @a@.execute(text(f"SELECT * FROM orders WHERE account_id = {@b@} LIMIT @n@"))
return rows.all()
''', "from sqlalchemy import text", '''
rows = @a@.execute(text("SELECT * FROM orders WHERE account_id = :account_id LIMIT @n@"), {"account_id": @b@})
return rows.all()
''', "A value from outside becomes part of the statement's text.", "Bind the value as a parameter."),
    _t("tarfile_path_traversal", 2, "import tarfile", '''
destination = @b@
with tarfile.open(@a@) as bundle:
    bundle.extractall(destination)
return destination
''', "import tarfile", '''
destination = @b@
with tarfile.open(@a@) as bundle:
    bundle.extractall(path=destination, filter="data")
return destination
''', "Members of an archive can be written anywhere.", "Extract with the data filter."),
    _t("httpx_client_ssrf", 2, "import httpx", '''
with httpx.Client(timeout=@n@) as client:
    return client.get(@a@).text
''', "import httpx", '''
address = httpx.URL(@a@)
if address.scheme != "https" or address.host not in @b@:
    raise ValueError("this host may not be asked")
with httpx.Client(timeout=@n@, follow_redirects=False) as client:
    return client.get(address).text
''', "The server fetches whatever address it is given.", "Allow listed hosts only and follow no redirects."),
    _t("zip_decompression_bomb", 2, "import zipfile", '''
with zipfile.ZipFile(@a@) as bundle:
    bundle.extractall(@b@)
    return bundle.namelist()
''', "import zipfile", '''
with zipfile.ZipFile(@a@) as bundle:
    total_size = sum(member.file_size for member in bundle.infolist())
    if total_size > 50000000 or len(bundle.infolist()) > 1000:
        raise ValueError("the archive unpacks to too much")
    bundle.extractall(@b@)
    return bundle.namelist()
''', "A small archive can unpack to any size.", "Add up sizes before unpacking."),
    _t("flask_session_fixation", 2, "", '''
@a@["user_id"] = @b@.id
return @a@
''', "", '''
@a@.clear()
@a@["user_id"] = @b@.id
@a@.permanent = False
return @a@
''', "A session made before sign-in goes on after it.", "Start a new session at sign-in."),
    _t("starlette_permissive_cors", 2, "from starlette.middleware.cors import CORSMiddleware", '''
@a@.add_middleware(CORSMiddleware, allow_origins=["*"], allow_credentials=True, max_age=@n@)
return @a@
''', "from starlette.middleware.cors import CORSMiddleware", '''
trusted_origins = [origin for origin in @b@ if origin.startswith("https://")]
@a@.add_middleware(CORSMiddleware, allow_origins=trusted_origins, allow_credentials=True, max_age=@n@)
return @a@
''', "Any site can read answers with a visitor's credentials.", "Allow listed origins."),
    _t("flask_insecure_cookie", 2, "", '''
@a@.set_cookie("visit", @b@, max_age=@n@, secure=False)
return @a@
''', "", '''
@a@.set_cookie("visit", @b@, max_age=@n@, secure=True, httponly=True, samesite="Lax")
return @a@
''', "A cookie travels unencrypted and scripts can read it.", "Mark the cookie as secure and closed to scripts."),
    _t("jinja_template_injection", 2, "from jinja2 import Template", '''
page = Template("<h2>" + @a@ + "</h2>")
return page.render(count=@b@)
''', "from jinja2.sandbox import SandboxedEnvironment", '''
rooms = SandboxedEnvironment(autoescape=True)
page = rooms.from_string("<h2>{{ value }}</h2>")
return page.render(value=@a@, count=@b@)
''', "Text from outside is compiled as a template.", "Pass the text as a value of a fixed template."),
    _t("mongodb_operator_injection", 2, "", '''
payload = {"username": @b@.get("username")}
return @a@.accounts.find_one(payload)
''', "", '''
username = @b@.get("username")
if not isinstance(username, str):
    raise ValueError("a name is text")
return @a@.accounts.find_one({"username": {"$eq": username}})
''', "An object from outside can hold operators.", "Require text and compare it literally."),
    _t("django_idor", 3, "", '''
invoice = @a@.objects.get(pk=@b@)
return invoice.as_dict()
''', "", '''
invoice = @a@.objects.get(pk=@b@, owner_id=@c@.pk)
return invoice.as_dict()
''', "Any number leads to somebody's record.", "Look among the caller's own records."),
    _t("flask_debug_mode", 1, "", '''
@a@.run(host="127.0.0.1", port=5000 + @n@, debug=True)
return @a@
''', "", '''
@a@.run(host="127.0.0.1", port=5000 + @n@, debug=False)
return @a@
''', "The debugger lets visitors run code.", "Run without the debugger."),
    _t("login_rate_limit", 3, "", '''
return @a@.check(@b@, @c@)
''', "", '''
if not @a@.limiter.allow("sign-in", @b@, per_minute=@n@):
    raise PermissionError("too many attempts")
return @a@.check(@b@, @c@)
''', "Passwords can be tried without end.", "Limit attempts."),
    _t("s3_public_acl", 3, "", '''
@a@.put_object(Bucket=@b@, Key="export/@n@", Body=@c@, ACL="public-read")
return "export/@n@"
''', "", '''
@a@.put_object(Bucket=@b@, Key="export/@n@", Body=@c@, ServerSideEncryption="aws:kms")
return "export/@n@"
''', "An object is readable by all.", "Keep the object private and encrypted."),
    _t("celery_pickle_serializer", 1, "", '''
@a@.conf.update(task_serializer="pickle", accept_content=["pickle"], worker_concurrency=@n@)
return @a@
''', "", '''
@a@.conf.update(task_serializer="json", accept_content=["json"], worker_concurrency=@n@)
return @a@
''', "Messages can run code when they are read.", "Exchange data-only messages."),
    _t("asyncio_command_injection", 2, "import asyncio", '''
job = asyncio.create_subprocess_shell("sort --parallel=@n@ " + @a@ + " -o " + @b@)
return asyncio.run(job)
''', "import asyncio", '''
job = asyncio.create_subprocess_exec("sort", "--parallel=@n@", "-o", @b@, "--", @a@)
return asyncio.run(job)
''', "A shell reads names from outside as part of a command.", "Start the program with a list of arguments."),
    _t("webhook_signature_validation", 3, "import json", '''
event = json.loads(@a@)
return event.get("kind"), @b@, @c@
''', "import hmac\nimport json", '''
expected = hmac.new(@b@, @a@, "sha256").hexdigest()
if not hmac.compare_digest(expected, @c@):
    raise PermissionError("the message was not signed by its sender")
event = json.loads(@a@)
return event.get("kind"), @b@, @c@
''', "Anybody can send events.", "Compare the message's signature."),
)


@dataclass(frozen=True)
class Form:
    """Text before and after a body, the body's indentation, and the expression by which a test reaches the code."""

    shape: str
    head: str
    indent: int
    tail: str
    entry: str


FORMS = (
    Form("function", "def @def@(@args@):\n", 4, "", "@def@"),
    Form("keyword_only", "def @def@(*, @args@):\n", 4, "", "@def@"),
    Form("service_method", "class @class@:\n    def @def@(self, @args@):\n", 8, "", "@class@.@def@"),
    Form("static_method", "class @class@:\n    @staticmethod\n    def @def@(@args@):\n", 8, "", "@class@.@def@"),
    Form("callable_object", "class @class@:\n    def __call__(self, @args@):\n", 8, "", "@class@.__call__"),
    Form("guarded_function", "def @def@(@args@):\n    if None in (@args@,):\n        raise TypeError(\"every argument is needed\")\n", 4, "", "@def@"),
    Form("two_stage", "def _open_@def@():\n    return 1 + 1 == 2\n\n\ndef @def@(@args@):\n    assert _open_@def@()\n", 4, "", "@def@"),
    Form("async_function", "import asyncio\n\n\nasync def @def@(@args@):\n    await asyncio.sleep(0)\n", 4, "", "@def@"),
    Form("class_method", "class @class@:\n    closed = False\n\n    @classmethod\n    def @def@(cls, @args@):\n        if cls.closed:\n            raise RuntimeError(\"closed\")\n", 8, "", "@class@.@def@"),
    Form("nested_handler", "def make_@def@():\n    def @def@(@args@):\n", 8, "\n    return @def@\n", "make_@def@()"),
    Form("branch_dispatch", "def @def@(@args@, *, active=True):\n    if not active:\n        return None\n", 4, "", "@def@"),
    Form("stateful_service", "class @class@:\n    def __init__(self, runs=0):\n        self.runs = runs\n\n    def @def@(self, @args@):\n        self.runs += 1\n", 8, "", "@class@.@def@"),
    Form("module_dispatch", "MODES_@def@ = {\"plain\": 1}\n\n\ndef @def@(@args@):\n    if \"plain\" not in MODES_@def@:\n        raise LookupError(\"no such mode\")\n", 4, "", "@def@"),
    Form("adapter_method", "class @class@:\n    sides = (\"left\", \"right\")\n\n    def adapt(self, @args@):\n        if len(self.sides) != 2:\n            raise LookupError(\"an adapter has two sides\")\n", 8, "", "@class@.adapt"),
    Form("policy_factory", "def policy_@def@(level=2):\n    def apply(@args@):\n        if level < 1:\n            raise ValueError(\"no policy below one\")\n", 8, "\n    return apply\n", "policy_@def@()"),
)

#: Words that names are drawn from.
VERBS = ("handle", "fetch", "prepare", "apply", "collect", "resolve", "update")
KINDS = ("Plain", "Strict", "Shared", "Remote", "Daily", "Inner")
NOUNS = (("source", "client", "stream", "record"), ("detail", "choice", "entry", "place"), ("rest", "bound", "owner", "extra"))
