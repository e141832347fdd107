"""Fixed schemas. Readers align to them; nothing is inferred."""

SPANS = (
    "session_id string, user_id string, account_id string, source string, span_id string, trace_id string, parent_id string, name string, span_kind string, start_time timestamp, end_time timestamp, "
    "status_code string, input_value string, output_value string, input_messages string, output_messages string, llm_model_name string, llm_token_count_prompt long, llm_token_count_completion long, "
    "llm_token_count_total long, backend string, raw_attributes string"
)
EVENTS = (
    "session_id string, event_id string, parent_event_id string, order_idx int, timestamp timestamp, event_type string, text string, tool_name string, tool_input string, tool_result string, "
    "subagent_type string, project_path string, git_branch string, raw_message_json string"
)
ANNOTATIONS = (
    "annotation_id string, span_id string, name string, annotator_kind string, label string, score double, explanation string, metadata string, created_at timestamp, updated_at timestamp, "
    "source string, user_id string, backend string"
)
LINE = (
    "type string, subtype string, uuid string, message struct<content:string>, toolUseResult string, compactMetadata struct<trigger:string,preTokens:long>, timestamp string, sessionId string, cwd string, gitBranch string"
)
