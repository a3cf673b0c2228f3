"""Queries over seeded task, skill and case tables; customers and orders give the seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions.binary import pack, unpack
from episodica.functions.draws import identifier
from episodica.operators import generate, records
from episodica.plans.episode_queries import joined
from episodica.plans.registry import query
from episodica.session import fresh_dir
from episodica.sources import recordfiles
from episodica.sources.tables import table


def _seeds(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("seed"))


def _draw(n: int, label: str, seed: str = "c_custkey") -> str:
    return f"(('0x' || substr(md5('{label}:' || {seed}), 1, 8))::BIGINT % {n})"


def _pick(options: list[str], label: str) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][{_draw(len(options), label)} + 1]"


AUTH = f"""
auth AS (SELECT c_custkey AS seed, {_pick(generate.API_NAMES, 'api')} AS api_name,
  ({_draw(9, 'major')} + 1) || '.' || {_draw(10, 'minor')} AS api_version,
  {_pick(generate.HASHES, 'hash')} AS algo, {_pick(generate.SIGNING, 'signing')} AS signing,
  {_pick(generate.HEADERS, 'header')} AS header FROM customer)"""

BINARY = f"""
bin AS (SELECT c_custkey AS seed, {_pick(generate.FORMAT_NAMES, 'format')} AS format_name,
  {_pick(generate.MAGICS, 'magic')} AS magic, {_pick(['big', 'little'], 'endian')} AS endian,
  ({_draw(5, 'major')} + 1) * 256 + {_draw(10, 'minor')} AS version,
  {generate.FLAG_SETS}[{_draw(len(generate.FLAG_SETS), 'flags')} + 1] AS flag_names FROM customer)"""

N_DISTRACTORS = f"(4 + {_draw(3, 'n_distractors')})"


@query("gen_auth", f"WITH {AUTH} SELECT *, upper(substr(api_name, 1, 3)) AS prefix FROM auth")
def gen_auth(spark, folder):
    return generate.auth_params(_seeds(spark, folder))


@query(
    "gen_auth_cases",
    f"""WITH {AUTH} SELECT seed, CAST(n AS INTEGER) AS case_id,
          CASE n WHEN 1 THEN 'test_key_' || seed WHEN 2 THEN 'another_key_' || seed ELSE 'k' || seed END AS api_key,
          CASE n WHEN 1 THEN 1700000000 + seed WHEN 2 THEN 1700000001 + seed ELSE seed END AS ts,
          CASE WHEN signing LIKE '%method%' THEN ['GET', 'POST', 'PUT', 'DELETE'][
            ('0x' || substr(md5('method' || n || ':' || seed), 1, 8))::BIGINT % 4 + 1] ELSE 'GET' END AS method,
          replace(header, '{{api}}', api_name) AS header_name
        FROM auth, (SELECT unnest([1, 2, 3]) AS n)""",
)
def gen_auth_cases(spark, folder):
    cases = generate.auth_cases(_seeds(spark, folder))
    return cases.select("seed", "case_id", "api_key", "ts", "method", "header_name")


@query(
    "sign_requests",
    """WITH q AS (
      SELECT o_orderkey, 'key_' || o_custkey AS api_key, epoch_ms(o_orderdate) AS ts,
             ['GET', 'POST', 'PUT', 'DELETE'][o_orderkey % 4 + 1] AS method,
             CASE WHEN o_orderkey % 5 < 3 THEN 'sha256' ELSE 'md5' END AS algo, o_orderkey % 4 AS s,
             o_custkey % 4 AS h FROM orders),
    m AS (SELECT *, CASE s WHEN 0 THEN api_key || ':' || ts WHEN 1 THEN ts || '.' || api_key
                      WHEN 2 THEN api_key || '|' || ts || '|' || method ELSE method || ':' || api_key || ':' || ts END AS text,
                 rpad(hex(api_key), 128, '0') AS k FROM q),
    x AS (SELECT *, array_to_string([printf('%02x', xor(('0x' || substr(k, 2 * i + 1, 2))::INTEGER, 54)) FOR i IN range(64)], '') AS ipad,
                 array_to_string([printf('%02x', xor(('0x' || substr(k, 2 * i + 1, 2))::INTEGER, 92)) FOR i IN range(64)], '') AS opad FROM m),
    g AS (SELECT *, base64(unhex(CASE WHEN algo = 'sha256' THEN sha256(unhex(opad || sha256(unhex(ipad || hex(text)))))
                                 ELSE md5(unhex(opad || md5(unhex(ipad || hex(text))))) END)) AS sig FROM x)
    SELECT o_orderkey, ['X-Orders-Auth', 'Authorization', 'X-Orders-Signature', 'X-Orders-Token'][h + 1] AS header_name,
           CASE h WHEN 0 THEN 'ORD ' || api_key || ':' || sig || ':' || ts WHEN 1 THEN 'Bearer ' || sig
                  WHEN 2 THEN 'ORD sig=' || sig || ',key=' || api_key || ',ts=' || ts
                  ELSE 'ORD ' || ts || ':' || sig END AS header_value FROM g""",
)
def sign_requests(spark, folder):
    """Every order as a request, in all signing and header forms, with two of the hashes."""
    def choice(options, at):
        return F.element_at(F.array(*map(F.lit, options)), (at % len(options) + 1).cast("int"))

    key = F.col("o_orderkey")
    requests = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit("key_"), "o_custkey").alias("api_key"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        choice(generate.METHODS, key).alias("method"),
        F.when(key % 5 < 3, "sha256").otherwise("md5").alias("algo"),
        choice(generate.SIGNING, key).alias("signing"),
        choice(generate.HEADERS, F.col("o_custkey")).alias("header"),
        F.lit("Orders").alias("api_name"),
        F.lit("ORD").alias("prefix"),
    )
    return generate.sign_requests(requests).select("o_orderkey", "header_name", "header_value")


@query(
    "gen_binary",
    f"WITH {BINARY} SELECT seed, format_name, magic, endian, version, array_to_string(flag_names, ',') AS flag_names FROM bin",
)
def gen_binary(spark, folder):
    return generate.binary_params(_seeds(spark, folder)).withColumn("flag_names", joined("flag_names"))


@query(
    "gen_binary_cases",
    f"""WITH {BINARY} SELECT seed, CAST(n AS INTEGER) AS case_id, version,
          CASE n WHEN 1 THEN 42 + seed % 100 WHEN 2 THEN 1 ELSE 1000 + seed END AS record_count,
          array_to_string([flag_names[i] || '=' || (n = 3 OR (n = 1 AND (i = 1 OR
            ('0x' || substr(md5('flag:' || seed || ':' || (i - 1)), 1, 8))::BIGINT % 2 = 1)))
            FOR i IN range(1, len(flag_names) + 1)], ',') AS flags, true AS ok
        FROM bin, (SELECT unnest([1, 2, 3]) AS n)""",
)
def gen_binary_cases(spark, folder):
    """Generated headers, decoded again: what comes back is what was asked for."""
    cases = generate.binary_cases(_seeds(spark, folder))
    seen = records.decode_header(F.col("data"), F.col("magic"), F.col("flag_names"), F.col("endian"))
    cases = cases.withColumn("seen", seen)
    pairs = F.transform(
        F.map_entries("seen.flag_values"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return cases.select(
        "seed", "case_id", F.col("seen.version").cast("long").alias("version"),
        F.col("seen.record_count").alias("record_count"), joined(pairs).alias("flags"),
        (F.col("seen.magic_ok") & F.col("seen.crc_ok")).alias("ok"),
    )


@query(
    "gen_tasks",
    f"""SELECT CASE WHEN {_draw(2, 'template')} = 0 THEN 'task_proc_auth_' ELSE 'task_proc_bin_' END || c_custkey AS task_id,
          'easy' AS difficulty, 'procedural' AS source,
          CASE WHEN {_draw(2, 'template')} = 0 THEN 'auth_protocol' ELSE 'binary_format' END AS template,
          CASE WHEN {_draw(2, 'template')} = 0 THEN 'skill_proc_auth_' ELSE 'skill_proc_bin_' END || c_custkey AS relevant,
          CAST({N_DISTRACTORS} AS INTEGER) AS n_distractors FROM customer""",
)
def gen_tasks(spark, folder):
    tasks = generate.gen_tasks(_seeds(spark, folder))
    return tasks.select(
        "task_id", "difficulty", "source", "template", joined("relevant").alias("relevant"),
        F.size("distractors").alias("n_distractors"),
    )


@query(
    "gen_docs",
    f"""WITH {AUTH}, {BINARY} SELECT 'skill_proc_auth_' || seed AS skill_id, api_name || ' API Authentication' AS name,
          'How requests to the ' || api_name || ' API v' || api_version || ' are signed.' AS short_description, seed
        FROM auth WHERE {_draw(2, 'template', 'seed')} = 0
        UNION ALL SELECT 'skill_proc_bin_' || seed, format_name || ' Format Specification',
          'Header layout, flags and checksum of ' || format_name || ' files.', seed
        FROM bin WHERE {_draw(2, 'template', 'seed')} = 1""",
)
def gen_docs(spark, folder):
    docs = generate.gen_skills(_seeds(spark, folder))
    return docs.where(F.length("full_content") > 100).drop("full_content")


@query("gen_seeds", "SELECT c_custkey, c_nationkey * 10000 + c_custkey AS seed FROM customer")
def gen_seeds(spark, folder):
    """Counter seeds: the nation is the base, the customer the counter."""
    rows = table(spark, folder, "customer")
    return rows.select("c_custkey", generate.seed_of(F.col("c_nationkey"), F.col("c_custkey")).alias("seed"))


@query(
    "gen_bank_complete",
    f"""SELECT 'relevant' AS role, count(*) AS "references", CAST(0 AS BIGINT) AS missing FROM customer
        UNION ALL SELECT 'distractor', CAST(sum({N_DISTRACTORS}) AS BIGINT), CAST(0 AS BIGINT) FROM customer""",
)
def gen_bank_complete(spark, folder):
    """Skills that generated tasks name, and how many of them no generated or pool skill describes."""
    seeds = _seeds(spark, folder)
    tasks = generate.gen_tasks(seeds)
    refs = tasks.select(F.lit("relevant").alias("role"), F.explode("relevant").alias("skill_id")).unionByName(
        tasks.select(F.lit("distractor").alias("role"), F.explode("distractors").alias("skill_id"))
    )
    known = generate.gen_skills(seeds).select("skill_id").unionByName(generate.pool_skills(spark).select("skill_id"))
    found = refs.join(known.distinct().withColumn("known", F.lit(1)), "skill_id", "left")
    return found.groupBy("role").agg(F.count(F.lit(1)).alias("references"), F.count_if(F.col("known").isNull()).alias("missing"))


@query(
    "generator_uniqueness",
    """SELECT count(DISTINCT o_custkey) AS seeds, count(DISTINCT o_custkey) AS tasks, true AS varied FROM orders""",
)
def generator_uniqueness(spark, folder):
    """The customers of all orders as seeds: a repeated seed always gives the same task."""
    seeds = table(spark, folder, "orders").select(F.col("o_custkey").alias("seed"))
    made = generate.gen_tasks(seeds)
    key = F.struct("task_id", "description", "relevant", "distractors")
    return made.agg(
        F.count_distinct("task_id").alias("seeds"),
        F.count_distinct(F.xxhash64(key)).alias("tasks"),
        (F.approx_count_distinct("description") >= 10).alias("varied"),
    )


@query(
    "prompt_dataset",
    """SELECT c_custkey AS prompt_id, 'system: You solve tasks. | user: Load the relevant skills and submit.' AS prompt
       FROM customer""",
)
def prompt_dataset(spark, folder):
    rows = _seeds(spark, folder).withColumnRenamed("seed", "prompt_id")
    out = generate.prompts(rows, "prompt_id", "You solve tasks.", "Load the relevant skills and submit.")
    said = F.transform("prompt", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return out.select("prompt_id", F.array_join(said, " | ").alias("prompt"))


@query(
    "fill_ids",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'e' || user_id ELSE md5('episode:' || event_id) END AS episode_id
       FROM events""",
)
def fill_ids(spark, folder):
    """Events of one type bring an episode id; the others get one, empty ids included."""
    kind = F.col("event_type")
    given = F.when(kind == "view", F.concat(F.lit("e"), "user_id")).when(kind == "click", "")
    return table(spark, folder, "events").select(
        "event_id", identifier(given, "episode", F.col("event_id")).alias("episode_id")
    )


CRC_STEP = "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END"

HEADERS = f"""
h AS (SELECT o_orderkey, '4E4F5642' || '0201' || printf('%08X', o_orderkey)
        || printf('%04X', CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END + CASE WHEN o_custkey % 2 = 1 THEN 2 ELSE 0 END
                          + CASE WHEN o_totalprice > 100000 THEN 4 ELSE 0 END) AS body FROM orders),
c AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(
          [[('0x' || substr(body, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(12)])),
          {CRC_STEP})) AS crc FROM h)"""


def _headers(spark, folder):
    flags = F.array(F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 1, F.col("o_totalprice") > 100000)
    data = records.encode_header(F.lit("NOVB"), F.lit(0x0201), F.col("o_orderkey"), flags)
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", data.alias("data"))


@query("encode_header", f"WITH {HEADERS} SELECT o_orderkey, body || printf('%08X', crc) AS data FROM c")
def encode_header(spark, folder):
    return _headers(spark, folder).select("o_orderkey", F.hex("data").alias("data"))


@query(
    "decode_header",
    """SELECT o_orderkey, 513 AS version, o_orderkey AS record_count, o_orderstatus = 'F' AS compressed,
         o_custkey % 2 = 1 AS encrypted, o_totalprice > 100000 AS checksummed,
         o_orderstatus <> 'P' AS crc_ok, true AS magic_ok FROM orders""",
)
def decode_header(spark, folder):
    """Headers of all orders; those of one status have their last byte flipped first."""
    broken = F.concat(F.substring("data", 1, 15), pack(255 - unpack(F.col("data"), 15, 1), 1))
    data = F.when(F.col("o_orderstatus") == "P", broken).otherwise(F.col("data"))
    rows = _headers(spark, folder).withColumn("data", data)
    names = F.array(F.lit("compressed"), F.lit("encrypted"), F.lit("checksummed"))
    rows = rows.withColumn("seen", records.decode_header(F.col("data"), F.lit("NOVB"), names))
    flags = [F.col("seen.flag_values")[n].alias(n) for n in ("compressed", "encrypted", "checksummed")]
    return rows.select(
        "o_orderkey", "seen.version", "seen.record_count", *flags, "seen.crc_ok", "seen.magic_ok"
    )


@query(
    "encode_records",
    """SELECT c_custkey AS record_id, '0003' || '01' || '0006' || hex('nation') || '00000004' || printf('%08X', c_nationkey)
         || '03' || '0004' || hex('name') || printf('%08X', strlen(c_name)) || hex(c_name)
         || '04' || '0004' || hex('rich') || '00000001' || CASE WHEN c_acctbal > 5000 THEN '01' ELSE '00' END AS data
       FROM customer""",
)
def encode_records(spark, folder):
    """Customers as records of three fields, built from a long table of fields."""
    fields = [
        records.int32_field("nation", F.col("c_nationkey")),
        records.string_field("name", F.col("c_name")),
        records.bool_field("rich", F.col("c_acctbal") > 5000),
    ]
    long = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("record_id"), F.posexplode(F.array(*fields)).alias("field_no", "field")
    )
    return records.encode_records(long).select("record_id", F.hex("data").alias("data"))


@query(
    "decode_records",
    """WITH c AS (SELECT *, c_custkey % 10 = 9 AS cut FROM customer)
       SELECT c_custkey AS record_id, 0 AS field_no, 'nation' AS name, 'int32' AS type, CAST(c_nationkey AS VARCHAR) AS value,
         NULL::DOUBLE AS float_value, CAST(19 AS BIGINT) AS next_offset, '' AS error FROM c WHERE NOT cut
       UNION ALL SELECT c_custkey, 1, 'balance', 'float64', NULL, c_acctbal, 41, '' FROM c WHERE NOT cut
       UNION ALL SELECT c_custkey, 2, 'name', 'string', c_name, NULL, 52 + strlen(c_name), '' FROM c WHERE NOT cut
       UNION ALL SELECT c_custkey, 3, 'rich', 'bool', CAST(c_acctbal > 5000 AS VARCHAR), NULL, 64 + strlen(c_name), '' FROM c WHERE NOT cut
       UNION ALL SELECT c_custkey, -1, NULL, NULL, NULL, NULL, -1, 'record ends at byte 30, 33 needed' FROM c WHERE cut""",
)
def decode_records(spark, folder):
    """Customers as records of all four field types, read back; some are cut short first."""
    data = records.encode_record(
        [
            records.int32_field("nation", F.col("c_nationkey")),
            records.float64_field("balance", F.col("c_acctbal")),
            records.string_field("name", F.col("c_name")),
            records.bool_field("rich", F.col("c_acctbal") > 5000),
        ]
    )
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        key.alias("record_id"),
        F.when(key % 10 == 9, F.substring(data, 1, 30)).otherwise(data).alias("data"),
        F.lit(0).alias("offset"),
    )
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("bool_value").cast("string"))
    return records.decode_records(rows).select(
        "record_id", F.coalesce("field_no", F.lit(-1)).alias("field_no"), "name", "type", value.alias("value"), "float_value",
        F.coalesce("next_offset", F.lit(-1)).alias("next_offset"), F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    "decode_record_files",
    """SELECT c_custkey AS int_value, 0 AS field_no, 'key' AS name, NULL AS string_value FROM customer
       UNION ALL SELECT NULL, 1, 'name', c_name FROM customer""",
)
def decode_record_files(spark, folder):
    """Customers as records in files with headers, found again and decoded in spans."""
    data = records.encode_record([records.int32_field("key", F.col("c_custkey")), records.string_field("name", F.col("c_name"))])
    place = fresh_dir(spark, "records")
    rows = table(spark, folder, "customer").select(data.alias("data"))
    recordfiles.write_records(rows, place).write.format("noop").mode("overwrite").save()
    read = recordfiles.read_records(spark, place)
    return read.select(F.col("int_value").cast(dict(table(spark, folder, "customer").dtypes)["c_custkey"]).alias("int_value"), "field_no", "name", "string_value")


@query(
    "record_file_headers",
    """SELECT true AS magic_ok, true AS crc_ok, 256 AS version, count(*) AS records FROM customer""",
)
def record_file_headers(spark, folder):
    """The headers of the same files, read as binary files, account for every customer."""
    data = records.encode_record([records.int32_field("key", F.col("c_custkey"))])
    place = fresh_dir(spark, "records")
    rows = table(spark, folder, "customer").select(data.alias("data"))
    recordfiles.write_records(rows, place).write.format("noop").mode("overwrite").save()
    heads = recordfiles.read_headers(spark, place, "RECS", [])
    return heads.groupBy("magic_ok", "crc_ok", "version").agg(F.sum("record_count").alias("records"))
