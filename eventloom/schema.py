"""Schemas of the records, as DDL."""

EVIDENCE = "struct<url:string,source_type:string,name:string,credibility_score:double,published_at:string>"
OPEN_SOURCE_RAW = (
    "project_name string, repo_url string, owner string, stars bigint, star_growth_week bigint, forks bigint, open_issues bigint, contributors bigint, "
    f"primary_language string, created_at string, updated_at string, tech_tags array<string>, description string, source_urls array<{EVIDENCE}>"
)
PAPER_RAW = f"paper_id string, title string, authors array<string>, institution string, published_at string, abstract string, category string, influence_hint string, source_urls array<{EVIDENCE}>"
ENTERPRISE_RAW = f"sub_type string, company string, title string, published_at string, content string, fields map<string,string>, related_event_ids array<string>, source_urls array<{EVIDENCE}>"
STANDARD_EVENT = (
    "event_id string, title string, category string, sub_type string, sub_tags array<string>, company string, product string, "
    f"source array<{EVIDENCE}>, time string, added_at string, description string, entities map<string,string>, accuracy_score double, importance_score double, status string"
)
FEEDBACK = "id string, event_id string, report_id string, agent_score double, human_score double, problem_tags array<string>, comment string, created_at timestamp"
REPORTED_KEY = "report_date string, category string, key string"
SNAPSHOT = "repo_url string, stars bigint, fetched_at string"
CACHE = "meta struct<written_at:string,window_hours:int,sources:array<string>,degraded:boolean>, items array<string>"
