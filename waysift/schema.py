"""Column layouts that the operators share, as DDL."""

#: One row per node of a trace's event graph.
EVENTS = "base_id string, node_id bigint, span_id string, parent_span_id string, tracepoint string, variant string, ts_ns bigint, is_synthetic boolean, kv map<string,string>"
#: One row per edge; edge_seq is the order of insertion and breaks ties.
EDGES = "base_id string, src bigint, dst bigint, duration_ns bigint, variant string, edge_seq bigint"
#: A node of a path.
STEP = "struct<pos:int,span_id:string,tracepoint:string,variant:string,ts_ns:bigint,is_synthetic:boolean,edge_ns:bigint>"
#: One row per path, a whole path in a row.
PATHS = f"base_id string, request_type string, hash string, duration_ns bigint, is_hypothetical boolean, path array<{STEP}>"
#: Gauges of one agent at one time.
NODE_STATS = "node string, ts_ns bigint, receive_bytes_per_sec bigint, transmit_bytes_per_sec bigint, receive_drop_per_sec bigint, transmit_drop_per_sec bigint, load_avg_1_min float, load_avg_5_min float, tasks_runnable bigint, trace_input_kbps float, agent_cpu_time double, trace_size bigint"

ENTRY, EXIT, ANNOTATION = "Entry", "Exit", "Annotation"
CHILD_OF, FOLLOWS_FROM = "ChildOf", "FollowsFrom"
UNKNOWN = "Unknown"
