"""A three-file pull request of a greenhouse controller: a humidity log whose
mean gained parameters, a new valve module, and a loosened requirements file."""

HUMIDITY = "\n".join([
    "@@ -1,4 +1,27 @@",
    " import math",
    "-def mean_humidity(bed):",
    "-    return sum(bed.readings) / len(bed.readings)",
    "-",
    "+import logging",
    '+STATION_TOKEN = "greenhouse-relay-7f"',
    "+class HumidityLog:",
    "+    def mean_humidity(self, bed, since=None, unit='percent'):",
    '+        sql = f"select * from humidity where bed = {bed}"',
    "+        return self.store.execute(sql)",
    "+    def badge(self, bed):",
    '+        return f"<span>{bed}</span>"',
    "+    def checksum(self, line):",
    "+        return sha1(line)",
    "+    def rule(self, text):",
    "+        return eval(text)",
    "+    def backfill(self, beds):",
    "+        for bed in beds:",
    "+            self.store.execute('insert into humidity values (?)', (bed,))",
    "+    def close(self):",
    "+        try:",
    "+            self.store.flush()",
    "+        except:",
    "+            return",
    "+    def read_and_reset(self, x):",
    "+        tmp = x",
    "+        # FIXME round later",
])

VALVES = "\n".join([
    "@@ -0,0 +1,7 @@",
    "+import requests",
    '+api_key = "valve-bus-9911"',
    "+zone_cache = dict()",
    "+def open_valve(zone, minutes):",
    '+    return requests.put("https://valves.example.org/" + zone, json=minutes)',
    "+def close_valve(zone):",
    '+    return requests.delete("https://valves.example.org/" + zone, timeout=3)',
])

REQUIREMENTS = "\n".join([
    "@@ -1,2 +1,8 @@",
    "-django==4.2",
    "-boto3==1.28.0",
    "+django",
    "+boto3>=1.20",
    "+jinja2==3.0.1",
    "+urllib3==1.25",
    "+setuptools",
    "+pyyaml",
    "+djnago==1.0",
    "+nose==1.3.7",
])

FILES = [
    ("farm/greenhouse", 1, 1, "beds/humidity.py", 61, 3, HUMIDITY),
    ("farm/greenhouse", 1, 2, "beds/valves.py", 24, 0, VALVES),
    ("farm/greenhouse", 1, 3, "requirements.txt", 8, 2, REQUIREMENTS),
]
FILES_SCHEMA = ("repo_name string, pr_number bigint, file_pos int, filename string, additions bigint, "
                "deletions bigint, patch string")
PRS = [("farm/greenhouse", 1, "iris")]
PRS_SCHEMA = "repo_name string, pr_number bigint, author string"


def files_df(spark, rows=None):
    return spark.createDataFrame(rows or FILES, FILES_SCHEMA)


def prs_df(spark):
    return spark.createDataFrame(PRS, PRS_SCHEMA)
