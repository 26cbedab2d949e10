"""Explicit schemas (DDL) of every input; nothing is inferred at read time."""

from __future__ import annotations

VALUE = ("struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,"
          "arrayValue:string,kvlistValue:string,bytesValue:string>")
_ATTRS = f"array<struct<key:string,value:{VALUE}>>"
_RESOURCE = f"struct<attributes:{_ATTRS}>"
_SCOPE = "struct<name:string,version:string>"
_SPAN = ("struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,"
         f"startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string>,attributes:{_ATTRS}>")
_POINT = (f"struct<attributes:{_ATTRS},timeUnixNano:string,explicitBounds:array<double>,"
          "bucketCounts:array<string>,exemplars:array<struct<traceId:string>>>")
_DATA = f"struct<dataPoints:array<{_POINT}>>"
_METRIC = (f"struct<name:string,unit:string,gauge:{_DATA},sum:{_DATA},histogram:{_DATA},"
           f"exponentialHistogram:{_DATA},summary:{_DATA}>")
_LOG = ("struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,"
        f"body:{VALUE},traceId:string,attributes:{_ATTRS}>")

OTLP_TRACES = (f"resourceSpans array<struct<resource:{_RESOURCE},"
               f"scopeSpans:array<struct<scope:{_SCOPE},spans:array<{_SPAN}>>>>>")
OTLP_METRICS = (f"resourceMetrics array<struct<resource:{_RESOURCE},"
                f"scopeMetrics:array<struct<scope:{_SCOPE},metrics:array<{_METRIC}>>>>>")
OTLP_LOGS = (f"resourceLogs array<struct<resource:{_RESOURCE},"
             f"scopeLogs:array<struct<scope:{_SCOPE},logRecords:array<{_LOG}>>>>>")

AGGREGATE_ROW = "Service string, Aggregate string, Fields string"

SCORE_REPORT = (
    "generated_at timestamp, window string, snapshot struct<fleet_score:double,services:array<struct<"
    "service:string,spec_score:double,category:string,findings:array<struct<rule_id:string,impact:string,"
    "stats:struct<observed:bigint,violations:bigint,ratio:double>>>>>>")

INCIDENTS = ("incident string, title string, start_ts timestamp, end_ts timestamp, services array<string>, "
             "expected_alerts array<string>, induced boolean, fault string, notes string")

_OBJECT = "struct<apiVersion:string,kind:string,metadata:struct<name:string,namespace:string>>"
_INJECTION = f"struct<id:string,args:struct<kubernetesObject:{_OBJECT}>>"
SCENARIO_CATALOGUE = (
    "id int, category string, complexity string, description string, "
    "environment struct<applications:array<struct<id:string>>>, "
    f"disruptions array<struct<injections:array<{_INJECTION}>,waitFor:struct<"
    f"preInjection:array<{_INJECTION}>,postInjection:array<{_INJECTION}>>>>")
