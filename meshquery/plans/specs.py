"""Constant tables the analyses read.  Fixed values: they decide the results and are stated as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Package, function, from, to, description
FLOWS = [
    ("fmt", "Sprintf", "arg:*", "return:0", "All args contribute to formatted string"),
    ("fmt", "Sprint", "arg:*", "return:0", "All args contribute to string"),
    ("fmt", "Sprintln", "arg:*", "return:0", "All args contribute to string"),
    ("strings", "Replace", "arg:0", "return:0", "Source string flows to result"),
    ("strings", "ReplaceAll", "arg:0", "return:0", "Source string flows to result"),
    ("strings", "ToLower", "arg:0", "return:0", "String flows to lowered result"),
    ("strings", "ToUpper", "arg:0", "return:0", "String flows to uppered result"),
    ("strings", "TrimSpace", "arg:0", "return:0", "String flows to trimmed result"),
    ("strings", "Trim", "arg:0", "return:0", "String flows to trimmed result"),
    ("strings", "TrimPrefix", "arg:0", "return:0", "String flows to trimmed result"),
    ("strings", "TrimSuffix", "arg:0", "return:0", "String flows to trimmed result"),
    ("strings", "Split", "arg:0", "return:0", "String flows to split parts"),
    ("strings", "Join", "arg:0", "return:0", "Slice elements flow to joined string"),
    ("strings", "Contains", "arg:0", "return:0", "String checked for containment"),
    ("strings", "HasPrefix", "arg:0", "return:0", "String checked for prefix"),
    ("strings", "HasSuffix", "arg:0", "return:0", "String checked for suffix"),
    ("strconv", "Atoi", "arg:0", "return:0", "String flows to int"),
    ("strconv", "ParseInt", "arg:0", "return:0", "String flows to int64"),
    ("strconv", "ParseFloat", "arg:0", "return:0", "String flows to float"),
    ("strconv", "ParseBool", "arg:0", "return:0", "String flows to bool"),
    ("strconv", "Itoa", "arg:0", "return:0", "Int flows to string"),
    ("strconv", "FormatInt", "arg:0", "return:0", "Int64 flows to string"),
    ("strconv", "FormatFloat", "arg:0", "return:0", "Float flows to string"),
    ("encoding/base64", "EncodeToString", "arg:0", "return:0", "Bytes flow to base64 string"),
    ("encoding/base64", "DecodeString", "arg:0", "return:0", "Base64 string flows to bytes"),
    ("encoding/hex", "EncodeToString", "arg:0", "return:0", "Bytes flow to hex string"),
    ("encoding/hex", "DecodeString", "arg:0", "return:0", "Hex string flows to bytes"),
    ("encoding/json", "Marshal", "arg:0", "return:0", "Value flows to JSON bytes"),
    ("encoding/json", "Unmarshal", "arg:0", "arg:1", "JSON bytes flow to target value"),
    ("gopkg.in/yaml.v2", "Marshal", "arg:0", "return:0", "Value flows to YAML bytes"),
    ("gopkg.in/yaml.v2", "Unmarshal", "arg:0", "arg:1", "YAML bytes flow to target value"),
    ("net/url", "QueryEscape", "arg:0", "return:0", "String flows to URL-escaped string"),
    ("net/url", "PathEscape", "arg:0", "return:0", "String flows to path-escaped string"),
    ("net/url", "QueryUnescape", "arg:0", "return:0", "URL-escaped flows to unescaped"),
    ("html", "EscapeString", "arg:0", "return:0", "String flows to HTML-escaped string"),
    ("html", "UnescapeString", "arg:0", "return:0", "HTML-escaped flows to unescaped"),
    ("filepath", "Join", "arg:*", "return:0", "Path elements flow to joined path"),
    ("filepath", "Clean", "arg:0", "return:0", "Path flows to cleaned path"),
    ("filepath", "Abs", "arg:0", "return:0", "Path flows to absolute path"),
    ("filepath", "Rel", "arg:1", "return:0", "Target path flows to relative path"),
    ("filepath", "Base", "arg:0", "return:0", "Path flows to base name"),
    ("filepath", "Dir", "arg:0", "return:0", "Path flows to directory"),
    ("filepath", "Ext", "arg:0", "return:0", "Path flows to extension"),
    ("path", "Join", "arg:*", "return:0", "Path elements flow to joined path"),
    ("path", "Clean", "arg:0", "return:0", "Path flows to cleaned path"),
    ("path", "Base", "arg:0", "return:0", "Path flows to base name"),
    ("io", "ReadAll", "arg:0", "return:0", "Reader content flows to bytes"),
    ("io", "Copy", "arg:1", "arg:0", "Source reader flows to destination writer"),
    ("os", "ReadFile", "arg:0", "return:0", "File path determines content read"),
    ("regexp", "MatchString", "arg:1", "return:0", "String flows to match result"),
    ("regexp", "Match", "arg:1", "return:0", "Bytes flow to match result"),
    ("bytes", "Join", "arg:0", "return:0", "Byte slices flow to joined result"),
    ("bytes", "TrimSpace", "arg:0", "return:0", "Bytes flow to trimmed result"),
    ("bytes", "Contains", "arg:0", "return:0", "Bytes checked for containment"),
    ("bytes", "Replace", "arg:0", "return:0", "Source bytes flow to result"),
    ("errors", "New", "arg:0", "return:0", "Message flows to error"),
    ("errors", "Unwrap", "arg:0", "return:0", "Wrapped error flows to inner error"),
    ("sort", "Slice", "arg:0", "arg:0", "Slice mutated in place"),
    ("sort", "Sort", "arg:0", "arg:0", "Sortable mutated in place"),
]

# Package, function, role, category, description
TAINTS = [
    ("net/http", "FormValue", "source", "http_input", "HTTP form value"),
    ("net/http", "PostFormValue", "source", "http_input", "HTTP POST form value"),
    ("net/http", "ReadRequest", "source", "http_input", "HTTP request read"),
    ("os", "Getenv", "source", "env", "Environment variable"),
    ("os", "ReadFile", "source", "file_read", "File read"),
    ("io", "ReadAll", "source", "io_read", "Reader content"),
    ("io", "Copy", "source", "io_read", "Stream copy"),
    ("bufio", "ReadString", "source", "io_read", "Buffered read"),
    ("bufio", "ReadLine", "source", "io_read", "Buffered line read"),
    ("encoding/json", "Unmarshal", "source", "deserialization", "JSON unmarshal"),
    ("encoding/json", "Decode", "source", "deserialization", "JSON stream decode"),
    ("encoding/xml", "Unmarshal", "source", "deserialization", "XML unmarshal"),
    ("gopkg.in/yaml.v2", "Unmarshal", "source", "deserialization", "YAML unmarshal"),
    ("gopkg.in/yaml.v3", "Unmarshal", "source", "deserialization", "YAML unmarshal"),
    ("os/exec", "Command", "sink", "command_injection", "OS command construction"),
    ("os/exec", "CommandContext", "sink", "command_injection", "OS command with context"),
    ("os/exec", "Run", "sink", "command_injection", "OS command execution"),
    ("os/exec", "Start", "sink", "command_injection", "OS command start"),
    ("os", "WriteFile", "sink", "file_write", "File write"),
    ("os", "Create", "sink", "file_write", "File creation"),
    ("os", "OpenFile", "sink", "file_write", "File open"),
    ("html/template", "Execute", "sink", "template_exec", "HTML template execution"),
    ("html/template", "ExecuteTemplate", "sink", "template_exec", "HTML template execution"),
    ("text/template", "Execute", "sink", "template_exec", "Text template execution"),
    ("database/sql", "Exec", "sink", "sql_injection", "SQL execution"),
    ("database/sql", "Query", "sink", "sql_injection", "SQL query"),
    ("database/sql", "QueryRow", "sink", "sql_injection", "SQL query single row"),
    ("net/http", "Redirect", "sink", "open_redirect", "HTTP redirect"),
    ("log", "Printf", "sink", "log_injection", "Log formatted output"),
    ("log", "Fatalf", "sink", "log_injection", "Log fatal output"),
    ("net/url", "QueryEscape", "barrier", "url_escape", "URL query escaping"),
    ("net/url", "PathEscape", "barrier", "url_escape", "URL path escaping"),
    ("html", "EscapeString", "barrier", "html_escape", "HTML entity escaping"),
    ("regexp", "MatchString", "barrier", "validation", "Regex match validation"),
    ("regexp", "Match", "barrier", "validation", "Regex validation"),
    ("strconv", "Atoi", "barrier", "type_conversion", "String to int"),
    ("strconv", "ParseInt", "barrier", "type_conversion", "String to int64"),
    ("strconv", "ParseFloat", "barrier", "type_conversion", "String to float"),
    ("strconv", "ParseBool", "barrier", "type_conversion", "String to bool"),
    ("filepath", "Clean", "barrier", "path_sanitize", "Path sanitization"),
    ("filepath", "Abs", "barrier", "path_sanitize", "Absolute path resolution"),
    ("path", "Clean", "barrier", "path_sanitize", "Path sanitization"),
    ("fmt", "Sprintf", "propagator", "string_format", "String formatting"),
    ("fmt", "Fprintf", "propagator", "string_format", "Formatted write"),
    ("strings", "Join", "propagator", "string_concat", "String concatenation"),
    ("strings", "Replace", "propagator", "string_transform", "String replacement"),
    ("strings", "ReplaceAll", "propagator", "string_transform", "String replace all"),
    ("strings", "TrimSpace", "propagator", "string_transform", "String trimming"),
    ("strings", "ToLower", "propagator", "string_transform", "Case conversion"),
    ("strings", "ToUpper", "propagator", "string_transform", "Case conversion"),
    ("strings", "Split", "propagator", "string_transform", "String splitting"),
    ("bytes", "Join", "propagator", "bytes_concat", "Bytes concatenation"),
    ("encoding/base64", "EncodeToString", "propagator", "encoding", "Base64 encoding"),
    ("encoding/base64", "DecodeString", "propagator", "encoding", "Base64 decoding"),
    ("encoding/hex", "EncodeToString", "propagator", "encoding", "Hex encoding"),
]

# Id, name, description, client's session type, server's session type, transport, encoding, pattern
PROTOCOLS = [
    ("scrape", "Target Scrape", "Prometheus HTTP-scrapes metrics from monitored targets at configured intervals", "!HTTP_GET{/metrics}; ?text{exposition_format}; end", "?HTTP_GET{/metrics}; !text{exposition_format}; end", "http", "text/plain", "request_response"),
    ("remote_write", "Remote Write", "Prometheus forwards time series samples to remote storage via HTTP POST with snappy-compressed protobuf", "!HTTP_POST{protobuf(WriteRequest)}; ?HTTP{status_code}; end", "?HTTP_POST{protobuf(WriteRequest)}; !HTTP{status_code}; end", "http", "protobuf+snappy", "request_response"),
    ("remote_read", "Remote Read", "Prometheus queries remote storage for historical samples via protobuf request/response", "!HTTP_POST{protobuf(ReadRequest)}; ?HTTP{protobuf(ReadResponse)}; end", "?HTTP_POST{protobuf(ReadRequest)}; !HTTP{protobuf(ReadResponse)}; end", "http", "protobuf+snappy", "request_response"),
    ("alertmanager_notify", "Alertmanager Notification", "Prometheus sends firing/resolved alerts to Alertmanager instances via JSON POST", "!HTTP_POST{json(Alert[])}; ?HTTP{status_code}; end", "?HTTP_POST{json(Alert[])}; !HTTP{status_code}; end", "http", "json", "request_response"),
    ("adapter_query", "Adapter Instant Query", "prometheus-adapter queries Prometheus /api/v1/query for point-in-time metric values", "!HTTP{verb, /api/v1/query, query=PromQL, time, timeout}; ?JSON{status, data:QueryResult}; end", "?HTTP{verb, /api/v1/query, query=PromQL, time, timeout}; !JSON{status, data:QueryResult}; end", "http", "json", "request_response"),
    ("adapter_query_range", "Adapter Range Query", "prometheus-adapter queries Prometheus /api/v1/query_range for time series data over an interval", "!HTTP{verb, /api/v1/query_range, query, start, end, step, timeout}; ?JSON{status, data:QueryResult}; end", "?HTTP{verb, /api/v1/query_range, query, start, end, step, timeout}; !JSON{status, data:QueryResult}; end", "http", "json", "request_response"),
    ("adapter_series", "Adapter Series Discovery", "prometheus-adapter queries Prometheus /api/v1/series to discover available metric names and labels", "!HTTP{verb, /api/v1/series, match[], start, end}; ?JSON{status, data:Series[]}; end", "?HTTP{verb, /api/v1/series, match[], start, end}; !JSON{status, data:Series[]}; end", "http", "json", "request_response"),
    ("k8s_custom_metrics", "Kubernetes Custom Metrics API", "Kubernetes API server (HPA) queries adapter for pod/object custom metrics", "!HTTP_GET{/apis/custom.metrics.k8s.io/v1beta2/*}; ?JSON{CustomMetricValueList}; end", "?HTTP_GET{/apis/custom.metrics.k8s.io/v1beta2/*}; !JSON{CustomMetricValueList}; end", "http", "json", "request_response"),
    ("k8s_external_metrics", "Kubernetes External Metrics API", "Kubernetes API server (HPA) queries adapter for cluster-external metrics", "!HTTP_GET{/apis/external.metrics.k8s.io/v1beta1/*}; ?JSON{ExternalMetricValueList}; end", "?HTTP_GET{/apis/external.metrics.k8s.io/v1beta1/*}; !JSON{ExternalMetricValueList}; end", "http", "json", "request_response"),
    ("k8s_resource_metrics", "Kubernetes Resource Metrics API", "Kubernetes API server queries adapter for CPU/memory resource metrics (replaces metrics-server)", "!HTTP_GET{/apis/metrics.k8s.io/v1beta1/*}; ?JSON{PodMetrics|NodeMetrics}; end", "?HTTP_GET{/apis/metrics.k8s.io/v1beta1/*}; !JSON{PodMetrics|NodeMetrics}; end", "http", "json", "request_response"),
    ("discovery", "Service Discovery", "Prometheus discovers scrape targets from external providers (Kubernetes, Consul, DNS, EC2, etc.)", "!API{provider_specific_query}; ?JSON{TargetGroup[]}; end", "?API{provider_specific_query}; !JSON{TargetGroup[]}; end", "http", "json", "request_response"),
    ("federation", "Prometheus Federation", "Hierarchical Prometheus scrapes another Prometheus /federate endpoint with PromQL matchers", "!HTTP_GET{/federate, match[]}; ?text{exposition_format}; end", "?HTTP_GET{/federate, match[]}; !text{exposition_format}; end", "http", "text/plain", "request_response"),
    ("otlp_ingest", "OTLP Metrics Ingestion", "External OTLP-compatible services push metrics to Prometheus via OTLP HTTP receiver", "!HTTP_POST{protobuf(ExportMetricsServiceRequest)}; ?HTTP{ExportMetricsServiceResponse}; end", "?HTTP_POST{protobuf(ExportMetricsServiceRequest)}; !HTTP{ExportMetricsServiceResponse}; end", "http", "protobuf", "request_response"),
    ("promql_api", "PromQL Query API", "External clients (Grafana, scripts, etc.) query Prometheus PromQL HTTP API", "!HTTP{GET|POST, /api/v1/query|query_range, query=PromQL}; ?JSON{status, data}; end", "?HTTP{GET|POST, /api/v1/query|query_range, query=PromQL}; !JSON{status, data}; end", "http", "json", "request_response"),
]

# Protocol, component, role, description
PARTICIPANTS = [
    ("scrape", "prometheus", "client", "Scrape manager pulls metrics from targets"),
    ("scrape", "target", "server", "Monitored service exposes /metrics endpoint"),
    ("remote_write", "prometheus", "client", "Queue manager batches and sends samples"),
    ("remote_write", "remote_storage", "server", "Remote write receiver (Thanos, Cortex, Mimir, etc.)"),
    ("remote_read", "prometheus", "client", "Querier fans out read requests to remote storage"),
    ("remote_read", "remote_storage", "server", "Remote read provider returns stored samples"),
    ("alertmanager_notify", "prometheus", "client", "Notifier manager sends alert batches"),
    ("alertmanager_notify", "alertmanager", "server", "Alertmanager receives and groups alerts"),
    ("adapter_query", "adapter", "client", "prometheus-adapter queries instant metric values"),
    ("adapter_query", "prometheus", "server", "Prometheus evaluates PromQL and returns results"),
    ("adapter_query_range", "adapter", "client", "prometheus-adapter queries time-range metric values"),
    ("adapter_query_range", "prometheus", "server", "Prometheus evaluates range PromQL queries"),
    ("adapter_series", "adapter", "client", "prometheus-adapter discovers available series"),
    ("adapter_series", "prometheus", "server", "Prometheus returns matching series metadata"),
    ("k8s_custom_metrics", "kubernetes", "client", "Kubernetes HPA queries custom metrics for scaling"),
    ("k8s_custom_metrics", "adapter", "server", "Adapter translates Kubernetes metric requests to PromQL"),
    ("k8s_external_metrics", "kubernetes", "client", "Kubernetes HPA queries external metrics"),
    ("k8s_external_metrics", "adapter", "server", "Adapter provides external metric values from Prometheus"),
    ("k8s_resource_metrics", "kubernetes", "client", "Kubernetes scheduler/HPA queries resource metrics"),
    ("k8s_resource_metrics", "adapter", "server", "Adapter provides CPU/memory metrics from Prometheus"),
    ("discovery", "prometheus", "client", "Discovery manager polls providers for target groups"),
    ("discovery", "provider", "server", "Cloud/infra API returns target lists"),
    ("federation", "prometheus_global", "client", "Global Prometheus scrapes shard /federate endpoints"),
    ("federation", "prometheus", "server", "Shard Prometheus serves federated metrics"),
    ("otlp_ingest", "external_service", "client", "OTLP-instrumented service pushes metrics"),
    ("otlp_ingest", "prometheus", "server", "OTLP write handler receives and converts metrics"),
    ("promql_api", "external_client", "client", "Grafana, scripts, or other consumers"),
    ("promql_api", "prometheus", "server", "Web API evaluates PromQL and returns JSON"),
    ("adapter_query", "client_golang", "contract", "API contract: httpAPI.Query defines the /api/v1/query client interface"),
    ("adapter_query_range", "client_golang", "contract", "API contract: httpAPI.QueryRange defines the /api/v1/query_range client interface"),
    ("adapter_series", "client_golang", "contract", "API contract: httpAPI.Series defines the /api/v1/series client interface"),
    ("promql_api", "client_golang", "contract", "API contract: v1.API interface defines the full Prometheus HTTP API surface"),
]

# Protocol, step, participant, direction, message type, payload encoding, description
STEPS = [
    ("scrape", 1, "client", "!", "HTTP GET /metrics", "none", "Prometheus sends HTTP GET to target /metrics endpoint"),
    ("scrape", 2, "server", "!", "text/plain exposition", "text/plain", "Target responds with metrics in exposition format"),
    ("scrape", 3, "client", "?", "text/plain exposition", "text/plain", "Prometheus receives and parses exposition data"),
    ("remote_write", 1, "client", "!", "protobuf WriteRequest", "protobuf+snappy", "Prometheus sends snappy-compressed protobuf WriteRequest"),
    ("remote_write", 2, "server", "!", "HTTP status", "none", "Remote storage acknowledges with HTTP status code"),
    ("remote_write", 3, "client", "?", "HTTP status", "none", "Prometheus checks status for retry logic"),
    ("adapter_query", 1, "client", "!", "HTTP query=PromQL&time=T", "form", "Adapter sends PromQL instant query with timestamp"),
    ("adapter_query", 2, "server", "!", "JSON APIResponse{data:QueryResult}", "json", "Prometheus evaluates PromQL, returns vector/scalar/matrix"),
    ("adapter_query", 3, "client", "?", "JSON APIResponse{data:QueryResult}", "json", "Adapter unmarshals QueryResult into custom metrics"),
    ("adapter_series", 1, "client", "!", "HTTP match[]=selector&start=T&end=T", "form", "Adapter sends series selector match parameters"),
    ("adapter_series", 2, "server", "!", "JSON APIResponse{data:Series[]}", "json", "Prometheus returns matching series with label sets"),
    ("adapter_series", 3, "client", "?", "JSON APIResponse{data:Series[]}", "json", "Adapter processes series for metric naming and listing"),
]

# Source, target, protocol, direction, label
LINKS = [
    ("prometheus", "target", "scrape", "→", "HTTP GET /metrics"),
    ("prometheus", "remote_storage", "remote_write", "→", "protobuf WriteRequest"),
    ("remote_storage", "prometheus", "remote_read", "→", "protobuf ReadResponse"),
    ("prometheus", "alertmanager", "alertmanager_notify", "→", "JSON alerts"),
    ("adapter", "prometheus", "adapter_query", "→", "PromQL instant query"),
    ("adapter", "prometheus", "adapter_query_range", "→", "PromQL range query"),
    ("adapter", "prometheus", "adapter_series", "→", "Series metadata query"),
    ("kubernetes", "adapter", "k8s_custom_metrics", "→", "Custom metrics API"),
    ("kubernetes", "adapter", "k8s_external_metrics", "→", "External metrics API"),
    ("kubernetes", "adapter", "k8s_resource_metrics", "→", "Resource metrics API"),
    ("prometheus", "provider", "discovery", "→", "Target discovery"),
    ("prometheus_global", "prometheus", "federation", "→", "Federated scrape"),
    ("external_service", "prometheus", "otlp_ingest", "→", "OTLP push"),
    ("external_client", "prometheus", "promql_api", "→", "PromQL HTTP API"),
]

# Protocol, component, role, endpoint type, column, its value, name patterns, url, confidence.
# A package with % is a LIKE pattern; a name without % is met whole; a url of None is none.
SERVER, CONTRACT = "server", "contract"  # urls by name, below
ENDPOINTS = [
    ("scrape", "prometheus", "client", "http_client", "package", "scrape", ["*scrapeLoop.run%", "*scrapeLoop.scrapeAndReport%"], None, 1.0),
    ("remote_write", "prometheus", "client", "http_client", "package", "storage/remote", ["*QueueManager.sendBatch%", "*QueueManager.Start%", "%Client.Store%"], None, 1.0),
    ("remote_write", "prometheus", "server", "http_handler", "package", "storage/remote", ["*writeHandler%"], "/api/v1/write", 1.0),
    ("remote_read", "prometheus", "client", "http_client", "package", "storage/remote", ["*Client.Read%", "*readHandler%"], None, 1.0),
    ("remote_read", "prometheus", "server", "http_handler", "package", "storage/remote", ["*readHandler.ServeHTTP%"], "/api/v1/read", 1.0),
    ("alertmanager_notify", "prometheus", "client", "http_client", "package", "notifier", ["*sendLoop.sendAll%", "*sendLoop.sendOne%", "*Manager.Send%"], None, 1.0),
    ("otlp_ingest", "prometheus", "server", "http_handler", "package", "storage/remote", ["*otlpWriteHandler.ServeHTTP%"], "/api/v1/otlp/v1/metrics", 1.0),
    ("promql_api", "prometheus", "server", "http_handler", "package", "web/api/v1", ["*API.query", "*API.queryRange", "*API.series", "*API.labelValues", "*API.labelNames", "*API.targets", "*API.alerts", "*API.rules", "*API.alertmanagers", "*API.remoteWrite", "*API.remoteRead", "*API.otlpWrite"], SERVER, 1.0),
    ("federation", "prometheus", "server", "http_handler", "package", "web", ["*Handler.federation%"], "/federate", 1.0),
    ("discovery", "prometheus", "client", "http_client", "package", "discovery/%", ["*Discovery.refresh%", "*Discovery.Run%", "%Discovery.Run%"], None, 0.9),
    ("adapter_query", "adapter", "client", "http_client", "project", "adapter", ["%queryClient%.Query"], "/api/v1/query", 1.0),
    ("adapter_query_range", "adapter", "client", "http_client", "project", "adapter", ["%queryClient%.QueryRange"], "/api/v1/query_range", 1.0),
    ("adapter_series", "adapter", "client", "http_client", "project", "adapter", ["%queryClient%.Series"], "/api/v1/series", 1.0),
    ("adapter_query", "adapter", "client", "http_transport", "project", "adapter", ["%httpAPIClient%.Do"], None, 0.9),
    ("adapter_query", "prometheus", "server", "http_handler", "package", "web/api/v1", ["*API.query"], "/api/v1/query", 1.0),
    ("adapter_query_range", "prometheus", "server", "http_handler", "package", "web/api/v1", ["*API.queryRange"], "/api/v1/query_range", 1.0),
    ("adapter_series", "prometheus", "server", "http_handler", "package", "web/api/v1", ["*API.series"], "/api/v1/series", 1.0),
    ("k8s_custom_metrics", "adapter", "server", "api_provider", "project", "adapter", ["%makeProvider%", "%NewPrometheusProvider%", "%customProvider%.GetMetricByName%", "%customProvider%.GetMetricBySelector%"], None, 0.8),
    ("k8s_external_metrics", "adapter", "server", "api_provider", "project", "adapter", ["%makeExternalProvider%", "%NewExternalPrometheusProvider%"], None, 0.8),
    ("k8s_resource_metrics", "adapter", "server", "api_provider", "project", "adapter", ["%addResourceMetricsAPI%", "%NewProvider%"], None, 0.8),
    ("adapter_query", "client_golang", "contract", "api_contract", "project", "client_golang", ["%httpAPI%.Query"], "/api/v1/query", 1.0),
    ("adapter_query_range", "client_golang", "contract", "api_contract", "project", "client_golang", ["%httpAPI%.QueryRange"], "/api/v1/query_range", 1.0),
    ("adapter_series", "client_golang", "contract", "api_contract", "project", "client_golang", ["%httpAPI%.Series"], "/api/v1/series", 1.0),
    ("promql_api", "client_golang", "contract", "http_transport", "project", "client_golang", ["%httpClient%.Do"], "/api/v1/*", 0.9),
    ("promql_api", "client_golang", "contract", "api_contract", "project", "client_golang", ["%httpAPI%"], CONTRACT, 1.0),
]

# Url by the first name pattern that fits; any other name has OTHER_URL
URLS = {
    SERVER: [
        ("*API.query", "/api/v1/query"),
        ("*API.queryRange%", "/api/v1/query_range"),
        ("*API.series%", "/api/v1/series"),
        ("*API.labelValues%", "/api/v1/label/*/values"),
        ("*API.labelNames%", "/api/v1/label/__name__/values"),
        ("*API.targets%", "/api/v1/targets"),
    ],
    CONTRACT: [
        ("%httpAPI%.Query", "/api/v1/query"),
        ("%httpAPI%.QueryRange%", "/api/v1/query_range"),
        ("%httpAPI%.Series%", "/api/v1/series"),
        ("%httpAPI%.LabelValues%", "/api/v1/label/*/values"),
        ("%httpAPI%.LabelNames%", "/api/v1/labels"),
        ("%httpAPI%.Targets", "/api/v1/targets"),
        ("%httpAPI%.Rules%", "/api/v1/rules"),
        ("%httpAPI%.Alerts", "/api/v1/alerts"),
        ("%httpAPI%.AlertManagers%", "/api/v1/alertmanagers"),
        ("%httpAPI%.Config%", "/api/v1/status/config"),
        ("%httpAPI%.Flags%", "/api/v1/status/flags"),
        ("%httpAPI%.TSDB", "/api/v1/status/tsdb"),
    ],
}
OTHER_URL = "/api/v1/*"
NOT_CONTRACT = ("%UnmarshalJSON%", "%marshalJSON%")

# Components outside the code analysed
EXTERNAL = ["target", "remote_storage", "alertmanager", "kubernetes", "provider", "prometheus_global", "external_service", "external_client"]

# What causal pairs and channel patterns say
CAUSES = {
    "IO": "Adapter receives series metadata (input), uses it to construct PromQL queries (output)",
    "OO": "Alert batches sent to same Alertmanager preserve FIFO ordering",
    "II": "Discovery updates from same provider must be processed sequentially",
}
CHANNELS = [
    ("pipeline", "!samples; ?ack; end", "Scrape loop → Appender → TSDB → Queue Manager → Remote Write: samples flow through internal pipeline"),
    ("request_response", "!PromQL_query; ?QueryResult; end", "Web API handler → PromQL engine → Storage: synchronous query evaluation"),
]


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema).coalesce(1)


def flows(spark: SparkSession) -> DataFrame:
    """T5: how data flow through known functions."""
    return _table(spark, FLOWS, "package string, func_name string, flow_from string, flow_to string, description string")


def taints(spark: SparkSession) -> DataFrame:
    """Sources, sinks, barriers and propagators."""
    return _table(spark, TAINTS, "package string, func_name string, role string, category string, description string")


def protocols(spark: SparkSession) -> DataFrame:
    """T33; is_dual holds where the server's type is the client's with ! and ? swapped."""
    swap = str.maketrans("!?", "?!")
    rows = [(*p, int(p[3].translate(swap) == p[4])) for p in PROTOCOLS]
    return _table(spark, rows, "id string, name string, description string, session_type_client string, session_type_server string, transport string, encoding string, pattern string, is_dual long")


def participants(spark: SparkSession) -> DataFrame:
    return _table(spark, PARTICIPANTS, "protocol_id string, component string, role string, description string")


def session_steps(spark: SparkSession) -> DataFrame:
    return _table(spark, STEPS, "protocol_id string, step_order long, participant string, direction string, message_type string, payload_encoding string, description string")


def links(spark: SparkSession) -> DataFrame:
    return _table(spark, LINKS, "source_component string, target_component string, protocol_id string, direction string, label string")
