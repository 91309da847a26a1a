"""Types of messages, interactions and evaluations."""

PART = "struct<type:string,start:int,end:int>"
MESSAGE = f"struct<role:string,text:string,parts:array<{PART}>>"
MESSAGES = f"array<{MESSAGE}>"
TEXT_PARTS = ("text", "reasoning", "tool_call", "tool_call_response")
#: The field of a part that holds its content.
CONTENT_FIELD = {"text": "content", "reasoning": "content", "tool_call": "arguments", "tool_call_response": "response"}
INFERENCE = ("chat", "text_completion", "generate_content")
SPAN = "trace_id string, span_id string, parent_span_id string, trace_flags int, service_name string, attributes map<string,variant>"
INTERACTION_COLUMNS = ("trace_id", "span_id", "parent_span_id", "trace_flags", "service_name", "operation_name", "provider_name", "request_model", "response_id", "system_instructions", "input_messages", "output_messages", "context_messages", "association_properties", "output_type", "finish_reasons")
#: What of an interaction goes on to its evaluations.
IDENTITY_COLUMNS = ("trace_id", "span_id", "trace_flags", "service_name", "operation_name", "provider_name", "request_model", "response_id", "association_properties")
RESULT = "struct<score:double,label:string,explanation:string,attributes:map<string,string>,error_type:string>"
CALL = "struct<operation_name:string,provider_name:string,request_model:string,response_model:string,server_address:string,server_port:int,input_tokens:long,output_tokens:long,cache_read_tokens:long,finish_reason:string,error_type:string,start_ns:long,end_ns:long>"
PASS, FAIL, EXEMPT = "pass", "fail", "exempt"
#: Bounds of the histograms.
SCORE_BOUNDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
DURATION_BOUNDS = [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
TOKEN_BOUNDS = [float(4**k) for k in range(14)]
CALL_BOUNDS = [0.01 * 2**k for k in range(14)]
