"""Seeded generation of task, skill and case tables; one narrow pass over the seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions.crypto import with_hmac
from episodica.functions.draws import draw, pick
from episodica.operators.catalog import sampled
from episodica.operators.records import encode_header

# Fixed values of the generator.
POOL = [
    "skill_proc_dist_001", "skill_proc_dist_002", "skill_proc_dist_003", "skill_proc_dist_004",
    "skill_proc_dist_005", "skill_proc_dist_006", "skill_proc_dist_007", "skill_proc_dist_008",
]
API_NAMES = [
    "Zephyr", "Nebula", "Quantum", "Prism", "Helix", "Vortex", "Apex", "Nimbus", "Zenith", "Orion",
    "Pulse", "Flux", "Stratos", "Cipher", "Forge", "Atlas", "Beacon", "Crest", "Drift", "Echo",
]
HASHES = ["sha256", "sha384", "sha512", "md5"]
SIGNING = ["key:timestamp", "timestamp.key", "key|timestamp|method", "method:key:timestamp"]
HEADERS = ["X-{api}-Auth", "Authorization", "X-{api}-Signature", "X-{api}-Token"]
METHODS = ["GET", "POST", "PUT", "DELETE"]
FORMAT_NAMES = [
    "NovaBin", "HexPack", "DataForge", "ByteStream", "PacketX", "BinFrame", "CrystalPack", "FluxBinary",
    "QuantumPack", "NexusBin", "VectorPack", "PulseBin", "ArchivX", "StreamPack", "CoreBin",
    "SignalPack", "MatrixBin", "GridPack", "TensorBin", "WavePack",
]
MAGICS = ["NOVB", "HXPK", "DFGE", "BYST", "PKTX", "BNFR", "CRPK", "FLXB", "QPAK", "NXBN"]
FLAG_SETS = [
    ["compressed", "encrypted", "checksummed"],
    ["compressed", "signed", "indexed"],
    ["encrypted", "compressed", "verified"],
    ["indexed", "compressed", "encrypted", "signed"],
]
FIRST_TIMESTAMP = 1_700_000_000


# Names, descriptions and contents of the pool skills, in the order of POOL.
POOL_TEXTS = [
    ("Queue Consumers", "How to read a message queue without losing messages.", "Acknowledge a message after its work is stored. Give each one an id, so that a second delivery is seen. Move a message that fails often to a queue of its own."),
    ("Cache Lifetimes", "When to keep and when to drop cached values.", "Give every entry a time to live. Drop entries when their source changes. Spread expiry times, so that not all entries are renewed at once."),
    ("Log Rotation", "Keeping log files small and complete.", "Start a new file by size and by day. Compress closed files. Delete files after the agreed time, never the open one."),
    ("Paging Through Lists", "Reading long lists page by page.", "Ask for the next page with the cursor of the last one. Stop at an empty page. Do not count on page numbers while rows are added."),
    ("Retry Rules", "Which failures to try again, and how often.", "Try again after time-outs and overload, not after wrong input. Wait twice as long each time, with some chance in it, and give up after five."),
    ("Schema Changes", "Changing tables while they are in use.", "Add a column that may be empty first, fill it, then require it. Never rename in one step: write both names, move the readers, drop the old one."),
    ("Feature Switches", "Turning new code on for some users.", "Choose users by a hash of their id, so that the choice stays. Name an owner and an end date for every switch."),
    ("Backup Checks", "Knowing that a backup can be restored.", "Restore the newest backup to an empty machine every week and compare row counts and sums. An untested backup counts as none."),
]


def pool_skills(spark: SparkSession) -> DataFrame:
    """The skills that distract from the relevant one: one row for each id of POOL."""
    fields = "skill_id string, name string, short_description string, full_content string"
    return spark.createDataFrame([(i, *texts) for i, texts in zip(POOL, POOL_TEXTS)], fields)


def seed_of(base: Column | int, counter: Column) -> Column:
    """The seed of a counter: base * 10000 + counter."""
    return (F.lit(base) if isinstance(base, int) else base).cast("long") * 10_000 + counter


def seeds(spark: SparkSession, n: int, base: int = 0) -> DataFrame:
    return spark.range(n).select(seed_of(base, F.col("id")).alias("seed"))


def distractors(seed: Column) -> Column:
    """Four to six pool skills without replacement."""
    size = (draw(3, "n_distractors", seed) + 4).cast("int")
    return sampled(POOL, size, "distractors", seed)


# --- signed headers -----------------------------------------------------------------


def signing_text(signing: Column, key: Column, ts: Column, method: Column) -> Column:
    ts = ts.cast("string")
    return (
        F.when(signing == SIGNING[0], F.concat_ws(":", key, ts))
        .when(signing == SIGNING[1], F.concat_ws(".", ts, key))
        .when(signing == SIGNING[2], F.concat_ws("|", key, ts, method))
        .when(signing == SIGNING[3], F.concat_ws(":", method, key, ts))
    )


def header_value(header: Column, prefix: Column, key: Column, sig: Column, ts: Column) -> Column:
    ts = ts.cast("string")
    return (
        F.when(header == HEADERS[0], F.concat(prefix, F.lit(" "), key, F.lit(":"), sig, F.lit(":"), ts))
        .when(header == HEADERS[1], F.concat(F.lit("Bearer "), sig))
        .when(header == HEADERS[2], F.concat(prefix, F.lit(" sig="), sig, F.lit(",key="), key, F.lit(",ts="), ts))
        .when(header == HEADERS[3], F.concat(prefix, F.lit(" "), ts, F.lit(":"), sig))
    )


def sign_requests(requests: DataFrame) -> DataFrame:
    """Header name and value per request.

    Needs api_key, ts, method, algo, signing, header, api_name and prefix.
    """
    text = signing_text(F.col("signing"), F.col("api_key"), F.col("ts"), F.col("method"))
    signed = with_hmac(requests, "_digest", F.col("algo"), F.col("api_key"), text)
    # base64 breaks lines at 76 characters, which the longest digest exceeds.
    sig = F.translate(F.base64("_digest"), "\r\n", "")
    return signed.withColumn("signature", sig).drop("_digest").withColumns(
        {
            "header_name": F.replace("header", F.lit("{api}"), F.col("api_name")),
            "header_value": header_value(
                F.col("header"), F.col("prefix"), F.col("api_key"), F.col("signature"), F.col("ts")
            ),
        }
    )


def auth_params(seeds: DataFrame) -> DataFrame:
    seed = F.col("seed")
    version = F.concat_ws(".", draw(9, "major", seed) + 1, draw(10, "minor", seed))
    return seeds.select(
        "seed",
        pick(API_NAMES, "api", seed).alias("api_name"),
        version.alias("api_version"),
        pick(HASHES, "hash", seed).alias("algo"),
        pick(SIGNING, "signing", seed).alias("signing"),
        pick(HEADERS, "header", seed).alias("header"),
    ).withColumn("prefix", F.upper(F.substring("api_name", 1, 3)))


def auth_cases(seeds: DataFrame) -> DataFrame:
    """Three requests per seed; the method is drawn only where the format signs it."""
    seed, signed = F.col("seed"), F.col("signing").contains("method")
    keys = [
        (F.concat(F.lit("test_key_"), seed), seed + FIRST_TIMESTAMP),
        (F.concat(F.lit("another_key_"), seed), seed + FIRST_TIMESTAMP + 1),
        (F.concat(F.lit("k"), seed), seed),
    ]
    cases = F.array(
        *[
            F.struct(
                F.lit(number).alias("case_id"), key.alias("api_key"), ts.alias("ts"),
                F.when(signed, pick(METHODS, f"method{number}", seed)).otherwise("GET").alias("method"),
            )
            for number, (key, ts) in enumerate(keys, 1)
        ]
    )
    rows = auth_params(seeds).withColumn("case", F.explode(cases))
    return sign_requests(rows.select("*", "case.*").drop("case"))


def _task(kind: str, template: str, description: Column) -> list[Column]:
    seed = F.col("seed")
    return [
        F.concat(F.lit(f"task_proc_{kind}_"), seed).alias("task_id"),
        F.lit("easy").alias("difficulty"),
        description.alias("description"),
        F.array(F.concat(F.lit(f"skill_proc_{kind}_"), seed)).alias("relevant"),
        distractors(seed).alias("distractors"),
        F.lit("cases").alias("verifier_kind"),
        F.lit("procedural").alias("source"),
        F.lit(template).alias("template"),
    ]


def auth_tasks(seeds: DataFrame) -> DataFrame:
    text = F.format_string(
        "Build the authentication header of the %s API, version %s: sign each request in the form "
        "`%s` with HMAC (%s) keyed by the API key, encode the digest as base64 and return the header. "
        "The exact header layout is in the matching skill.",
        "api_name", "api_version", "signing", "algo",
    )
    return auth_params(seeds).select(*_task("auth", "auth_protocol", text))


def auth_skills(seeds: DataFrame) -> DataFrame:
    name = F.replace("header", F.lit("{api}"), F.col("api_name"))
    layout = header_value(F.col("header"), F.col("prefix"), F.lit("<KEY>"), F.lit("<SIG>"), F.lit("<TS>"))
    content = F.concat_ws(
        "\n",
        F.format_string("# %s API v%s: signed requests", "api_name", "api_version"),
        F.format_string("Text to sign: `%s`.", "signing"),
        F.format_string("Digest: HMAC with %s, keyed by the UTF-8 bytes of the API key.", "algo"),
        F.lit("Signature: base64 of the raw digest bytes."),
        F.format_string("Header `%s` carries `%s`.", name, layout),
    )
    return auth_params(seeds).select(
        F.concat(F.lit("skill_proc_auth_"), "seed").alias("skill_id"),
        F.concat("api_name", F.lit(" API Authentication")).alias("name"),
        F.format_string("How requests to the %s API v%s are signed.", "api_name", "api_version").alias("short_description"),
        content.alias("full_content"),
        "seed",
    )


# --- binary headers -----------------------------------------------------------------


def binary_params(seeds: DataFrame) -> DataFrame:
    seed = F.col("seed")
    major, minor = draw(5, "major", seed) + 1, draw(10, "minor", seed)
    return seeds.select(
        "seed",
        pick(FORMAT_NAMES, "format", seed).alias("format_name"),
        pick(MAGICS, "magic", seed).alias("magic"),
        pick(["big", "little"], "endian", seed).alias("endian"),
        (F.shiftleft(major, 8) + minor).alias("version"),
        F.element_at(F.array(*[F.array(*map(F.lit, names)) for names in FLAG_SETS]), (draw(len(FLAG_SETS), "flags", seed) + 1).cast("int")).alias("flag_names"),
    )


def binary_cases(seeds: DataFrame) -> DataFrame:
    """Three headers per seed: some flags (the first always), no flag, every flag."""
    seed, names = F.col("seed"), F.col("flag_names")
    some = F.transform(names, lambda n, i: (i == 0) | (draw(2, "flag", seed, i) == 1))
    wanted = [
        (seed % 100 + 42, some),
        (F.lit(1).cast("long"), F.transform(names, lambda n: F.lit(False))),
        (seed + 1000, F.transform(names, lambda n: F.lit(True))),
    ]
    cases = F.array(
        *[
            F.struct(F.lit(number).alias("case_id"), count.alias("record_count"), flags.alias("flag_values"))
            for number, (count, flags) in enumerate(wanted, 1)
        ]
    )
    rows = binary_params(seeds).withColumn("case", F.explode(cases)).select("*", "case.*").drop("case")
    data = encode_header(
        F.col("magic"), F.col("version"), F.col("record_count"), F.col("flag_values"), F.col("endian")
    )
    return rows.withColumn("data", data)


def binary_tasks(seeds: DataFrame) -> DataFrame:
    text = F.format_string(
        "Parse the 16-byte header of a %s file: check the magic bytes and the checksum, and return the "
        "version, the record count and the flags %s. The byte layout is in the matching skill.",
        F.col("format_name"), F.array_join("flag_names", ", "),
    )
    return binary_params(seeds).select(*_task("bin", "binary_format", text))


def binary_skills(seeds: DataFrame) -> DataFrame:
    bits = F.transform("flag_names", lambda n, i: F.format_string("- bit %d: %s", i, n))
    content = F.concat_ws(
        "\n",
        F.format_string("# %s header, 16 bytes, %s-endian", "format_name", "endian"),
        F.format_string("0-3 magic `%s`; 4-5 version (major in the high byte);", "magic"),
        F.lit("6-9 record count; 10-11 flags; 12-15 CRC32 of bytes 0-11. Reject a wrong CRC32."),
        F.lit("Flags:"),
        F.array_join(bits, "\n"),
    )
    return binary_params(seeds).select(
        F.concat(F.lit("skill_proc_bin_"), "seed").alias("skill_id"),
        F.concat("format_name", F.lit(" Format Specification")).alias("name"),
        F.format_string("Header layout, flags and checksum of %s files.", "format_name").alias("short_description"),
        content.alias("full_content"),
        "seed",
    )


# --- any template -------------------------------------------------------------------

TASK_TEMPLATES = {"auth_protocol": auth_tasks, "binary_format": binary_tasks}
SKILL_TEMPLATES = {"auth_protocol": auth_skills, "binary_format": binary_skills}


def _by_template(builders: dict, seeds: DataFrame, template: str | None) -> DataFrame:
    if template is not None:
        if template not in builders:
            raise ValueError(f"unknown template {template!r}; there are {sorted(builders)}")
        return builders[template](seeds)
    out = None
    drawn = draw(len(builders), "template", F.col("seed"))
    for number, build in enumerate(builders.values()):
        made = build(seeds.where(drawn == number))
        out = made if out is None else out.unionByName(made)
    return out


def gen_tasks(seeds: DataFrame, template: str | None = None) -> DataFrame:
    """One task per seed; the seed draws the template unless one is given."""
    return _by_template(TASK_TEMPLATES, seeds, template)


def gen_skills(seeds: DataFrame, template: str | None = None) -> DataFrame:
    return _by_template(SKILL_TEMPLATES, seeds, template)


def prompts(df: DataFrame, prompt_id: str, system: str, user: str) -> DataFrame:
    """The same two-message prompt for every row."""
    messages = [F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("system", system), ("user", user))]
    return df.select(prompt_id, F.array(*messages).alias("prompt"))
