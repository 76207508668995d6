"""The inputs of the queries, derived from the given tables by Spark.

One SQL text per input. The SQL the results are checked against is the same text with
four dialect replacements, so both sides start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.session import scratch_dir

PACKETS = """
 WITH e AS (
  SELECT event_id, user_id AS u, event_type AS et,
   CAST(get_json_object(props,'$.k') AS INTEGER) AS k,
   CAST(floor(value*100+0.5) AS BIGINT) AS cents,
   (unix_micros(CAST(ts AS TIMESTAMP))-1704067200000000) DIV (CASE WHEN user_id%5=0 THEN 4000 ELSE 40000 END) AS ts_us
  FROM events),
 a AS (SELECT *,
  CASE WHEN u%10<7 THEN 6 WHEN u%10<9 THEN 17 ELSE 1 END AS proto,
  '192.168.' || CAST(1+u DIV 200 AS STRING) || '.' || CAST(1+u%200 AS STRING) AS client,
  CASE u%6 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '142.250.4.91' WHEN 2 THEN '192.168.1.254' WHEN 3 THEN '192.168.56.10' WHEN 4 THEN '239.255.255.250' ELSE '157.240.1.35' END AS server,
  40000+u AS cport,
  CASE u%4 WHEN 0 THEN 443 WHEN 1 THEN 22 WHEN 2 THEN 53 ELSE 80 END AS sport_srv,
  k<60 AS fwd FROM e)
 SELECT event_id AS pkt_id, ts_us,
  CASE WHEN fwd THEN client ELSE server END AS src_ip,
  CASE WHEN fwd THEN server ELSE client END AS dst_ip,
  CAST(CASE WHEN proto=1 THEN (CASE WHEN fwd THEN 8 ELSE 0 END) WHEN fwd THEN cport ELSE sport_srv END AS BIGINT) AS sport,
  CAST(CASE WHEN proto=1 THEN 0 WHEN fwd THEN sport_srv ELSE cport END AS BIGINT) AS dport,
  CAST(proto AS INTEGER) AS proto,
  CAST(54+cents%1461 AS BIGINT) AS pkt_len,
  CAST(CASE WHEN proto<>6 THEN NULL WHEN et='signup' THEN 2 WHEN et='view' THEN 16 WHEN et='click' THEN 24
   WHEN et='purchase' THEN (CASE WHEN k%7=0 THEN 17 ELSE 48 END)
   ELSE (CASE WHEN k%10=9 THEN 4 WHEN k%10=8 THEN 144 ELSE 80 END) END AS INTEGER) AS tcp_flags,
  CAST(CASE WHEN proto=6 THEN 1024+k*640 END AS INTEGER) AS tcp_window,
  CAST(CASE WHEN proto=6 AND k%50<>7 THEN 5+k%11 END AS INTEGER) AS tcp_dataofs,
  CAST(CASE WHEN proto=6 THEN (CASE WHEN et IN ('signup','error') THEN 0 ELSE cents%1461 END) END AS BIGINT) AS tcp_payload_len,
  CASE WHEN u%2=0 THEN 'Wi-Fi' ELSE 'Ethernet' END AS iface,
  CASE WHEN fwd THEN (CASE u%4 WHEN 0 THEN '0c:74:c2' WHEN 1 THEN '04:18:d6' WHEN 2 THEN 'd8:0d:17' ELSE '02:00:00' END)
    || ':00:' || lpad(CAST(u DIV 100 AS STRING),2,'0') || ':' || lpad(CAST(u%100 AS STRING),2,'0')
   ELSE 'aa:bb:cc:00:00:01' END AS src_mac
 FROM a
"""

DNS_ANSWERS = """
 SELECT page_id AS ans_id, CAST((page_id*7919003)%64800000 AS BIGINT) AS ts_us,
  regexp_extract(url,'^https?://([^/:?#]+)',1) AS qname,
  CASE page_id%3 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '142.250.4.91' ELSE '157.240.1.35' END AS answer_ip
 FROM pages
"""

CONTROL_MSGS = """
 WITH e AS (SELECT event_id, user_id AS u, event_type AS et, CAST(get_json_object(props,'$.k') AS INTEGER) AS k,
   (unix_micros(CAST(ts AS TIMESTAMP))-1704067200000000) DIV 40000 AS ts_us FROM events),
 a AS (SELECT *, '192.168.' || CAST(1+u DIV 200 AS STRING) || '.' || CAST(1+u%200 AS STRING) AS ip,
  (CASE u%4 WHEN 0 THEN '0C:74:C2' WHEN 1 THEN '04:18:d6' WHEN 2 THEN 'd8:0d:17' ELSE '02:00:00' END)
    || ':00:' || lpad(CAST(u DIV 100 AS STRING),2,'0') || ':' || lpad(CAST(u%100 AS STRING),2,'0') AS mac FROM e)
 SELECT event_id AS msg_id, ts_us,
  CASE et WHEN 'signup' THEN 'dhcp' WHEN 'view' THEN 'mdns' WHEN 'click' THEN 'arp' WHEN 'purchase' THEN 'ssdp' ELSE 'dns' END AS kind,
  CASE WHEN et IN ('view','purchase') THEN (CASE WHEN k%9=0 THEN '8.8.8.8' ELSE ip END) END AS src_ip,
  CASE WHEN et IN ('signup','view','purchase') THEN mac END AS src_mac,
  CASE WHEN et='signup' THEN 1+k%8 END AS dhcp_type,
  CASE WHEN et='signup' AND k%4<>0 THEN 'host-' || CAST(u AS STRING) END AS dhcp_hostname,
  CASE WHEN et='signup' AND k%3<>0 THEN ip END AS dhcp_requested,
  CASE WHEN et='signup' THEN (CASE WHEN k%2=0 THEN '0.0.0.0' ELSE ip END) END AS dhcp_ciaddr,
  CASE WHEN et='view' AND k%2=0 THEN 'Phone-' || CAST(u AS STRING) || '.local.' WHEN et='view' AND k%5=0 THEN '_http._tcp.example.' END AS mdns_rrname,
  CASE WHEN et='view' AND k%3=0 THEN 'Tablet-' || CAST(u AS STRING) || '.local.' END AS mdns_qname,
  CASE WHEN et='click' THEN 1+k%2 END AS arp_op,
  CASE WHEN et='click' THEN (CASE WHEN k%10=0 THEN 'AA:BB:CC:00:00:01' ELSE mac END) END AS arp_hwsrc,
  CASE WHEN et='click' THEN (CASE WHEN k%7=0 THEN '0.0.0.0' ELSE ip END) END AS arp_psrc,
  CASE WHEN et='click' THEN 'aa:bb:cc:00:00:01' END AS arp_hwdst,
  CASE WHEN et='click' THEN '192.168.1.254' END AS arp_pdst,
  CASE WHEN et='error' THEN k%2 END AS dns_qr,
  CASE WHEN et='error' THEN k%3 END AS dns_qdcount
 FROM a
"""

DIRTY_FLOWS = """
 SELECT l_orderkey, l_linenumber,
  CAST(CAST(l_quantity AS INTEGER) AS STRING) AS tot_fwd_pkts,
  CASE WHEN l_suppkey%97=0 THEN 'abc' WHEN l_partkey%89=0 THEN NULL WHEN l_partkey%83=0 THEN '1e12' WHEN l_tax=0 THEN 'Infinity' WHEN l_partkey%79=0 THEN '-Infinity'
   ELSE CAST(CAST(floor(l_extendedprice*100+0.5) AS BIGINT) AS STRING) END AS flow_byts_s,
  CAST(CAST(floor(l_discount*100+0.5) AS INTEGER) AS STRING) AS syn_flag_cnt,
  '0' AS bulk_zero,
  CASE WHEN l_quantity>45 AND l_discount>0.05 THEN (CASE WHEN l_returnflag='R' THEN 'Bot' ELSE 'DDoS' END)
   WHEN l_linestatus='F' THEN 'BENIGN' ELSE 'Benign' END AS Label
 FROM lineitem
"""

SCORED = """
 SELECT o_orderkey, y, ((o_orderkey*7919)%800 + y*200)/1000.0D AS score
 FROM (SELECT o_orderkey, CASE WHEN o_totalprice>200000 THEN 1 ELSE 0 END AS y FROM orders) t
"""

DERIVED = {
    "packets": (PACKETS, "events"),
    "dns_answers": (DNS_ANSWERS, "pages"),
    "control_msgs": (CONTROL_MSGS, "events"),
    "dirty_flows": (DIRTY_FLOWS, "lineitem"),
    "scored": (SCORED, "orders"),
}

# Lookups that are inputs of the queries: (rank, suffix, name), gateways, host names.
TEST_SERVICES = ((1, "example.com", "ExCom"), (2, "example.net", "ExNet"), (3, "ththth.example.com", "Shadowed"))
GATEWAYS = (("192.168.1.254", "aa:bb:cc:00:00:01"),)
OWN_MACS = ("aa:bb:cc:00:00:01",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Packets and control messages are what a capture job leaves as a table; the queries start
# from such a table, written once per application, instead of working it out in every scan.
STAGED = ("packets", "control_msgs")
_staged: dict[tuple, str] = {}


def table_state(spark: SparkSession, path: str) -> tuple:
    """The path with the number, bytes and last change of its files: another table under the same path has another state."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getContentSummary(folder)
    return path, size.getFileCount(), size.getLength(), files.getFileStatus(folder).getModificationTime()


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, source = DERIVED[name]

    def derived() -> DataFrame:
        return spark.sql(text.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))

    if name not in STAGED:
        return derived()
    key = (spark.sparkContext.applicationId, name, *table_state(spark, f"{sf_dir}/{source}.parquet"))
    if key not in _staged:
        path = scratch_dir(spark, name)
        derived().write.parquet(path)
        _staged[key] = path
    return spark.read.parquet(_staged[key])


def duckdb_text(name: str) -> str:
    text = DERIVED[name][0]
    for spark_form, duckdb_form in (
        ("unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"),
        ("get_json_object(props,'$.k')", "json_extract_string(props,'$.k')"),
        (" DIV ", " // "),
        ("AS STRING", "AS VARCHAR"),
        ("1000.0D", "CAST(1000 AS DOUBLE)"),
    ):
        text = text.replace(spark_form, duckdb_form)
    return text


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Check SQL over derived inputs: ``names`` is a blank-separated list of views."""
    views = ", ".join(f"{n} AS ({duckdb_text(n)})" for n in names.split())
    body = body.strip()
    rest = ", " + body[5:].lstrip() if body[:5].upper() == "WITH " else " " + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{rest}"
