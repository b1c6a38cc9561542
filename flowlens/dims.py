"""Dictionaries: the fixed values the classifiers use, and their DataFrame form.

Every dictionary can be replaced: pass a ``Dictionaries`` with your own rows.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------

# category id | label | sensitivity | identifier tokens
PII_CATEGORIES = [
    ("address", "Address", "pii",
     "streetaddress homeaddress billingaddress shippingaddress mailingaddress postaladdress"),
    ("bank", "Bank account", "financial", "iban accountnumber routing sortcode"),
    ("card", "Card details", "financial", "creditcard debitcard cardnumber ccn cvv cvc"),
    ("credential", "Credential", "credential",
     "secret apikey accesstoken refreshtoken privatekey clientsecret"),
    ("device", "Device / IP", "pii", "ipaddress useragent deviceid"),
    ("dob", "Date of birth", "pii", "dob birthdate dateofbirth birthday"),
    ("email", "Email", "pii", "email emailaddress"),
    ("geo", "Location", "pii", "latitude longitude geolocation gps"),
    ("govid", "Government ID", "pii", "passport taxid ein vat"),
    ("health", "Health", "health", "diagnosis medical patient"),
    ("name", "Name", "pii", "firstname lastname fullname surname givenname familyname"),
    ("password", "Password", "credential", "password passwd pwd"),
    ("phone", "Phone", "pii", "phone telephone mobile msisdn"),
    ("special", "Special category", "special", "gender ethnicity religion"),
    ("ssn", "National ID", "pii", "ssn socialsecurity sin nino"),
    ("username", "Username", "pii", "username userid"),
]

NAME_QUALIFIERS = "first last full given family user customer contact display legal".split()
ADDRESS_QUALIFIERS = "street home billing shipping mailing postal residential delivery".split()

# token -> display name, in alphabetical order (the order decides ties)
VENDORS = [
    ("amplitude", "Amplitude"), ("anthropic", "Anthropic"), ("auth0", "Auth0"),
    ("braintree", "Braintree"), ("datadog", "Datadog"), ("hubspot", "HubSpot"),
    ("intercom", "Intercom"), ("mailchimp", "Mailchimp"), ("mailgun", "Mailgun"),
    ("mixpanel", "Mixpanel"), ("openai", "OpenAI"), ("paypal", "PayPal"), ("plaid", "Plaid"),
    ("posthog", "PostHog"), ("segment", "Segment"), ("sendgrid", "SendGrid"),
    ("sentry", "Sentry"), ("slack", "Slack"), ("stripe", "Stripe"), ("twilio", "Twilio"),
]

# infrastructure token -> store node it refines, concrete label
INFRA_TOKENS = [
    ("aws_db_instance", "store:db", "Database (Amazon RDS)"),
    ("aws_rds_cluster", "store:db", "Database (Amazon Aurora)"),
    ("google_sql_database_instance", "store:db", "Database (Cloud SQL)"),
    ("azurerm_postgresql_server", "store:db", "PostgreSQL (Azure)"),
    ("digitalocean_database_cluster", "store:db", "Managed database (DigitalOcean)"),
    ("postgres", "store:db", "PostgreSQL"),
    ("postgresql", "store:db", "PostgreSQL"),
    ("mysql", "store:db", "MySQL"),
    ("mariadb", "store:db", "MariaDB"),
    ("cockroach", "store:db", "CockroachDB"),
    ("aws_s3_bucket", "store:object", "Amazon S3 bucket"),
    ("google_storage_bucket", "store:object", "GCS bucket"),
    ("azurerm_storage_account", "store:object", "Azure Blob storage"),
    ("aws_elasticache_cluster", "store:cache", "Redis (ElastiCache)"),
    ("redis", "store:cache", "Redis"),
    ("memcached", "store:cache", "Memcached"),
    ("aws_dynamodb_table", "store:dynamo", "Amazon DynamoDB"),
    ("mongo", "store:mongo", "MongoDB"),
    ("mongodb", "store:mongo", "MongoDB"),
]

# sensitivity | rank | display label
SENSITIVITIES = [
    ("public", 1, "Public"), ("pii", 2, "PII"), ("financial", 3, "Financial"),
    ("health", 4, "Health"), ("credential", 4, "Credential"), ("special", 4, "Special"),
]
# the order in which filter chips are listed
SENSITIVITY_CHIPS = ["pii", "financial", "credential", "health", "special", "public"]

# kind | column order | system shown for a call target of that kind
KINDS = [
    ("source", 0, ""), ("service", 1, ""), ("store", 2, "Data stores"),
    ("sink", 3, "Sinks"), ("external", 4, "Third parties"),
]

LOG_RECEIVERS = "log logger logging console slog logrus zap winston pino klog glog".split()
LOG_METHODS = ("log logf logln debug info warn warning error fatal trace "
               "print println printf sprintf").split()
STORE_METHODS = ("save insert insertone insertmany create upsert put putitem write persist store add set "
                 "setex hset exec execute query update merge bulkwrite copy append create_all put_item").split()
STORE_RECEIVERS = ("db dba database repo repository model models orm store collection coll table tbl redis "
                   "rdb cache kv bucket s3 gcs blob dynamo dynamodb mongo mongodb prisma sequelize knex gorm "
                   "ecto datastore session conn pool tx sql").split()
HTTP_METHODS = "fetch request get post put patch delete head do send urlopen urlretrieve".split()
HTTP_RECEIVERS = ("http https axios requests urllib httpx httpclient httpoison finch got ky superagent "
                  "undici net client api").split()
COMMS_WORDS = ("sendmail send_mail sendemail send_email sendsms send_sms sendmessage send_message mailer "
               "transporter nodemailer smtp postmark deliver_now deliver_later publish enqueue").split()
COMMS_WHOLE_WORDS = ["notify"]
# store verbs that need no store word in the receiver
SELF_EVIDENT_STORE_METHODS = ["insert", "upsert", "save"]
# store words by family; every other store word is family "db"
STORE_FAMILIES = {
    "cache": ("redis rdb cache kv".split(), "Redis / cache"),
    "object": ("s3 gcs blob bucket".split(), "Object store"),
    "mongo": ("mongo mongodb".split(), "MongoDB"),
    "dynamo": ("dynamo dynamodb".split(), "DynamoDB"),
}

PLACEHOLDER_WORDS = (r"example\.com|test|foo|bar|baz|john\.?doe|jane\.?doe|lorem|dummy|sample|"
                     r"placeholder|xxx+|changeme|your_?")

IGNORED_DIRS = (".git node_modules vendor dist build .next target __pycache__ .venv venv .idea .vscode obj "
                "_build .terraform coverage .cache .pytest_cache deps").split()
SKIPPED_EXTENSIONS = ".json .lock .map .csv .tsv .svg .snap .sum .min .ipynb".split()
LOCKFILES = ("package-lock.json yarn.lock pnpm-lock.yaml composer.lock poetry.lock gemfile.lock "
             "cargo.lock").split()
MAX_FILE_BYTES = 1 << 20

# what makes a file an infrastructure file: extensions, starts of names, whole names, languages; YAML by words in its path
INFRA_EXTENSIONS = ".tf .tfvars".split()
INFRA_NAME_STARTS = "docker-compose compose. serverless.".split()
INFRA_NAMES = "chart.yaml values.yaml".split()
INFRA_LANGUAGES = "hcl terraform".split()
YAML_EXTENSIONS = ".yaml .yml".split()
DEPLOY_WORDS = "k8s kubernetes manifest /deploy chart helm".split()

# labels of call targets that no dictionary names
COMMS_LABEL, HTTP_LABEL, LOG_LABEL, STORE_LABEL, DB_LABEL = "Email / messaging", "External HTTP", "Logs", "Data store", "Database"

# ---- end of fixed values ----------------------------------------------------

def builtin_pii_tokens() -> list[tuple[str, str, str, str]]:
    return [(t, cid, label, sens) for cid, label, sens, toks in PII_CATEGORIES for t in toks.split()]


@dataclass(frozen=True)
class Dictionaries:
    """Dictionary rows used by the classifiers. They are lists on the driver and constants in a plan, of any size that a
    driver holds; an entry is found by hash, so a look-up takes as long in a large dictionary as in a small one."""

    pii_tokens: list[tuple] = field(default_factory=builtin_pii_tokens)
    name_qualifiers: list[str] = field(default_factory=lambda: list(NAME_QUALIFIERS))
    address_qualifiers: list[str] = field(default_factory=lambda: list(ADDRESS_QUALIFIERS))
    vendors: list[tuple] = field(default_factory=lambda: list(VENDORS))
    infra: list[tuple] = field(default_factory=lambda: list(INFRA_TOKENS))

    def __post_init__(self):
        seen: dict[str, tuple] = {}
        for _, cid, label, sens in self.pii_tokens:
            if seen.setdefault(cid, (label, sens)) != (label, sens):
                raise ValueError(f"category {cid!r} has more than one label or sensitivity")

    def categories(self) -> list[tuple[str, str, str]]:
        rows = {cid: (label, sens) for _, cid, label, sens in self.pii_tokens}
        # the two qualifier rules name these categories even if no token does
        rows.setdefault("name", ("Name", "pii"))
        rows.setdefault("address", ("Address", "pii"))
        return sorted((cid, *rest) for cid, rest in rows.items())

    @classmethod
    def from_frames(cls, pii_tokens: DataFrame | None = None, vendors: DataFrame | None = None,
                    infra: DataFrame | None = None, qualifiers: DataFrame | None = None) -> "Dictionaries":
        """Build from DataFrames shaped like ``dim_*``; frames left out keep the built-in rows."""
        kw: dict = {}
        if pii_tokens is not None:
            kw["pii_tokens"] = _rows(pii_tokens.select("token", "cat_id", "cat_label", "sensitivity"))
        if vendors is not None:
            kw["vendors"] = sorted(_rows(vendors.select("token", "name")))
        if infra is not None:
            kw["infra"] = _rows(infra.select("token", "enrich_id", "label"))
        if qualifiers is not None:
            rows = _rows(qualifiers.select("kind", "token"))
            kw["name_qualifiers"] = sorted(t for k, t in rows if k == "name")
            kw["address_qualifiers"] = sorted(t for k, t in rows if k == "address")
        return cls(**kw)


def _rows(df: DataFrame) -> list[tuple]:
    """Dictionary rows on the driver."""
    return [tuple(r) for r in df.collect()]


BUILTIN = Dictionaries()


def dim_pii_token(spark: SparkSession, d: Dictionaries = BUILTIN) -> DataFrame:
    return spark.createDataFrame(d.pii_tokens, "token string, cat_id string, cat_label string, sensitivity string")


def dim_category(spark: SparkSession, d: Dictionaries = BUILTIN) -> DataFrame:
    return spark.createDataFrame(d.categories(), "id string, label string, sensitivity string")


def dim_qualifier(spark: SparkSession, d: Dictionaries = BUILTIN) -> DataFrame:
    rows = [("name", t) for t in d.name_qualifiers] + [("address", t) for t in d.address_qualifiers]
    return spark.createDataFrame(rows, "kind string, token string")


def dim_vendor(spark: SparkSession, d: Dictionaries = BUILTIN) -> DataFrame:
    return spark.createDataFrame(d.vendors, "token string, name string")


def dim_infra(spark: SparkSession, d: Dictionaries = BUILTIN) -> DataFrame:
    return spark.createDataFrame(d.infra, "token string, enrich_id string, label string")


def dim_sensitivity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENSITIVITIES, "sensitivity string, rank int, label string")


def dim_kind(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, o) for k, o, _ in KINDS], "kind string, col_order int")


def quoted(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(pairs, key: Column) -> Column:
    """The value of a key among constant (key, value) pairs, null if it is not there.

    A map is searched from end to end, so the pairs are dealt to many small maps by the key's checksum. All are one
    constant that the optimizer parses from text once.
    """
    table = dict(pairs)
    size = 1 << len(table).bit_length()
    maps: list[dict[str, str]] = [{} for _ in range(size)]
    for k, v in table.items():
        maps[zlib.crc32(k.encode()) % size][k] = v
    dealt = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")
    return F.element_at(F.get(dealt, (F.crc32(key.cast("binary")) % size).cast("int")), key)


def one_of(value: Column, words) -> Column:
    """Is a value one of a few words? Null for a null value."""
    return F.array_contains(F.expr("array(" + ", ".join(quoted(w) for w in words) + ")"), value)
