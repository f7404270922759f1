"""Table schemas as DDL strings: everything is keyed by project, so a workspace is one table and not a loop."""

from __future__ import annotations

NODES = ("project string, id string, kind string, file_path string, language string, line long, is_local boolean, alternative_paths array<string>")
EDGES = ("project string, src string, dst string, kind string, weight long, line long, confidence double, confidence_kind string")
METRICS = ("project string, id string, betweenness double, pagerank double, in_degree long, out_degree long, in_cycle boolean, score double, community_id long, hotspot_type string")
COMMUNITIES = ("project string, community_id long, members array<string>, cohesion double")
CYCLES = ("project string, cycle_id long, nodes array<string>")

#: analysis.json; absent keys read as null, unknown keys are ignored.
ANALYSIS = (
    "generated_at string, allowlisted_symbols array<string>, "
    "nodes array<struct<id:string,betweenness:double,pagerank:double,in_degree:long,out_degree:long,in_cycle:boolean,score:double,community_id:long,hotspot_type:string>>, "
    "communities array<struct<id:long,members:array<string>,cohesion:double>>, cycles array<array<string>>, "
    "summary struct<total_nodes:long,total_edges:long,total_communities:long,total_cycles:long>, "
    "edges array<struct<source:string,target:string,kind:string,confidence:double,confidence_kind:string,source_community:long,target_community:long,in_cycle:boolean>>"
)
#: graph.json, node-link form.
GRAPH = (
    "directed boolean, multigraph boolean, "
    "nodes array<struct<id:string,kind:string,file_path:string,language:string,line:long,is_local:boolean,alternative_paths:array<string>>>, "
    "links array<struct<source:string,target:string,kind:string,weight:long,line:long,confidence:double,confidence_kind:string>>"
)
#: history/<nanoseconds>.json
HISTORY = (
    "captured_at long, project string, summary struct<total_nodes:long,total_edges:long,total_communities:long,total_cycles:long>, "
    "top_hotspots array<struct<id:string,score:double>>, "
    "confidence_summary struct<extracted_count:long,extracted_pct:double,inferred_count:long,inferred_pct:double,ambiguous_count:long,ambiguous_pct:double,expected_external_count:long,expected_external_pct:double,mean_confidence:double>, "
    "nodes array<struct<id:string,score:double,community_id:long,in_degree:long,out_degree:long,in_cycle:boolean>>, "
    "communities array<struct<id:long,members:array<string>,cohesion:double>>"
)

EDGE_KINDS = ("Imports", "Defines", "Calls")
NODE_KINDS = ("Module", "Function", "Class", "Method", "Trait", "Enum")
CONFIDENCE_KINDS = ("Extracted", "Inferred", "Ambiguous", "ExpectedExternal")
LANGUAGES = ("Python", "TypeScript", "Go", "Rust", "Php")
#: What a user may type for a node kind.
KIND_WORDS = {"module": "Module", "mod": "Module", "function": "Function", "fn": "Function", "func": "Function", "class": "Class", "struct": "Class", "method": "Method", "trait": "Trait", "interface": "Trait", "enum": "Enum"}


def parse_node_kind(word: str) -> str:
    try:
        return KIND_WORDS[word.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown node kind {word!r}; one of {', '.join(sorted(KIND_WORDS))}") from None
