"""Corpora made from the driver's tables: source lines, import edges, designs and a log.

The tables hold prose, so lines of code are planted in them by id.  Every
corpus has a form in SQL, over the same tables, for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines of code, hits and near misses of the rules.
SNIPPETS = r'''
except :
except KeyError:
print(total)
print (total)
x = 1  # FIXME later
    # TODO tune
todo = []
from math import *
from math import pi
if d.has_key(k): pass
has_key(k)
if ok == True:
if ok == TrueValue:
if v ==None:
if v is None:
console.log(a)
var n = 0;
let n = 0;
if (a === b) {}
a >= b;
db.execute("DELETE FROM t WHERE k = %d" % k + "")
# db.execute("x %s")
db.execute("SELECT 1")
db.execute("SELECT a FROM t WHERE k=" + k)
db.execute("select a where k=" + k)
db.execute(f"DROP {t}")
db.execute(q)
Token = "abcdefgh"
token = "abcdefg"
// token = "abcdefgh"
private_key = "k"
box.innerHTML = v
* box.innerHTML = v
document.write(v)
document.write (v)
os.system("ls " + d)
os.system("ls")
f = open(base + "../x")
p = "../x"
LOG.info(Password)
"""log the password"""
r = random.random ()
r = random.randint(1, 2)
cur.EXECUTE("a = %s")
cur.execute("a = %d")
execute(f'X {t}')
execute('X')
execute("a=" + b)
execute('a=' + b)
db.rawquery(q + k)
db.rawQuery(q)
os.system(a + b)
OS.system(a + b)
subprocess.Popen(a + b)
subprocess.run(a + b)
eval(a + b)
eval(a)
passwd = "abcd"
passwd = "abc"
# passwd = "abcd"
APIKEY='12345678'
APIKEY='1234567'
jwt_secret = "12345678"
// token = "12345678"
AWS_access_key = "A"
aws_key = ""
u = "http://h.example/API"
u = "http://localhost/api"
u = "http://h.example/x"
b.innerHTML=v
b.outerHTML = v
b.outerHtml = v
document.writeln(v)
<i dangerouslySetInnerHTML={x}/>
<i dangerouslySetHTML={x}/>
o = pickle.load(fh)
q = (r"pickle.load(")
o = cPickle.loads(s)
o = cpickle.dump(s)
o = dill.load(s)
o = dill.dumps(s)
o = yaml.load (s)
o = yaml.safe_load(s)
o = marshal.loads(s)
o = marshal.loads(s, for'x')
logger.info(PASSWORD)
password_logger = 1
log token
token log
log.debug(secret)
secret = log
login credit
credit login
print(password)
password = print
import a from '../a'
import a from './a'
os.path.join(d, request.p)
os.path.join(d, req.p)
open(d + request.p)
open(request.p)
hashlib.md5 (b)
hashlib.sha256(b)
hashlib.sha1(b)
hashlib.sha1
random.random()
secrets.token_hex()
random.randint(1, 6)
random.choice(x)
@app.route("/users")
@router.get("/items")
@login_required
@require_auth
def handler(request):
return render(page)
    # password = "abcdefgh"
log.info("order placed")
'''.replace("QQQ", "'" * 3)[1:-1].split("\n")

#: Suffixes and folders of the planted files, by remainders of the user's id.
FILE_SUFFIXES = (".py", ".js", ".ts", ".html", ".json", ".jsx", ".yml")
FOLDERS = ("build", "__pycache__", "api/controllers", "core/services", "db/repositories", "models", "app/handlers", "src/a", "src/b", "src/c", "lib/d", "lib/e", "lib/f")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return ", ".join(quoted(x) for x in items)


def pick(items, index):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (index + 1).cast("int"))


def planted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, file_name, suffix, line_no, line): a file for each user of events, a line for each event."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    user = F.col("user_id")
    name = F.concat(F.when(user % 11 == 0, "Example_").otherwise("u"), user.cast("string"), pick(FILE_SUFFIXES, user % len(FILE_SUFFIXES)))
    rows = events.withColumn("file_name", name).withColumn("path", F.concat(pick(FOLDERS, user % len(FOLDERS)), F.lit("/"), name))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("int")
    return rows.select("path", "file_name", pick(FILE_SUFFIXES, user % len(FILE_SUFFIXES)).alias("suffix"), number.alias("line_no"), pick(SNIPPETS, F.col("event_id") % len(SNIPPETS)).alias("line"))


def planted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, file_name, suffix) of the planted files."""
    return planted_lines(spark, sf_dir).select("path", "file_name", "suffix").distinct()


PLANTED_SQL = f"""named AS (
  SELECT user_id, event_id,
         CASE WHEN user_id % 11 = 0 THEN 'Example_' ELSE 'u' END || user_id::VARCHAR || ([{listed(FILE_SUFFIXES)}])[(user_id % {len(FILE_SUFFIXES)} + 1)::INT] AS file_name,
         ([{listed(FILE_SUFFIXES)}])[(user_id % {len(FILE_SUFFIXES)} + 1)::INT] AS suffix,
         ([{listed(FOLDERS)}])[(user_id % {len(FOLDERS)} + 1)::INT] AS folder
  FROM events),
planted AS (
  SELECT folder || '/' || file_name AS path, folder, file_name, suffix,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS line_no,
         ([{listed(SNIPPETS)}])[(event_id % {len(SNIPPETS)} + 1)::INT] AS line
  FROM named)"""

#: One statement a file, as one error voids a file.
STATEMENTS = (
    "m.eval()", "g().eval()", "x[0].exec()", "a.b().pickle.loads(z)", "f()()", "eval(a); exec(b)", "import pickle as p; p.loads(z)",
    'db_password = "abcde"', 'db_password = "abcd"', 'self.token = "abcdef"', 'token: str = "abcdef"', "from . import x", "from .a import b",
    "import a.b, c", "def broken(:", "os.system(c)", "yaml.load(s, Loader=L)", 'API_KEY = token = "0123456789"', "subprocess.run(c)", "eval(eval(a))",
)


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, file_name, suffix, parts, content) of a Python file of one statement for each event."""
    from ..sources.files import with_path_parts
    from ..sources.spread import spread

    events = table(spark, sf_dir, "events")
    rows = events.select(F.concat(F.lit("ast/"), F.col("event_id").cast("string"), F.lit(".py")).alias("path"), pick(STATEMENTS, F.col("event_id") % len(STATEMENTS)).alias("content"))
    return spread(with_path_parts(rows))


#: Layers of the planted architecture, with what each must not import.
LAYERS = (("api", ("repository", "model")), ("service", ("api",)), ("repository", ("api", "service")), ("model", ("api", "service", "repository")))
ARCH_FOLDERS = ("app/api", "app/service", "app/repository", "app/domain", "app/handlers", "lib/other", "app/dao")


def design_json() -> str:
    import json

    return json.dumps({"architecture": {"layers": [{"name": n, "forbidden_dependencies": list(f), "allowed_dependencies": ["model"]} for n, f in LAYERS]}})


def arch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): a module for each part; names recur in several folders."""
    part = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(pick(ARCH_FOLDERS, part % len(ARCH_FOLDERS)), F.lit("/mod"), (part % 500).cast("string"), F.lit("_"), (part % 3).cast("string"), F.lit(".py")).alias("path")).distinct()


def arch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, seq, module): imports of the modules, by name, by dotted path, and of what isn't there."""
    part = F.col("p_partkey")
    path = F.concat(pick(ARCH_FOLDERS, part % len(ARCH_FOLDERS)), F.lit("/mod"), (part % 500).cast("string"), F.lit("_"), (part % 3).cast("string"), F.lit(".py"))
    other = (part * 7 + 3) % 500
    by_name = F.concat(F.lit("pkg.mod"), other.cast("string"), F.lit("_"), (part % 3).cast("string"))
    by_path = F.concat(pick(("app.api", "app.service", "app.repository", "lib.other"), part % 4), F.lit(".mod"), (other % 50).cast("string"))
    modules = F.array(by_name, by_path, F.lit("os"))
    return table(spark, sf_dir, "part").select(path.alias("path"), F.posexplode(modules).alias("pos", "module")).select("path", (F.col("pos")).alias("seq"), "module").distinct()


_ARCH_PATH = f"([{listed(ARCH_FOLDERS)}])[(p_partkey % {len(ARCH_FOLDERS)} + 1)::INT] || '/mod' || (p_partkey % 500)::VARCHAR || '_' || (p_partkey % 3)::VARCHAR || '.py'"
ARCH_SQL = f"""afiles AS (SELECT DISTINCT {_ARCH_PATH} AS path FROM part),
aedges AS (
  SELECT DISTINCT path, seq, module FROM (
    SELECT {_ARCH_PATH} AS path, 0 AS seq, 'pkg.mod' || ((p_partkey * 7 + 3) % 500)::VARCHAR || '_' || (p_partkey % 3)::VARCHAR AS module FROM part
    UNION ALL
    SELECT {_ARCH_PATH}, 1, (['app.api', 'app.service', 'app.repository', 'lib.other'])[(p_partkey % 4 + 1)::INT] || '.mod' || (((p_partkey * 7 + 3) % 500) % 50)::VARCHAR FROM part
    UNION ALL
    SELECT {_ARCH_PATH}, 2, 'os' FROM part))"""
