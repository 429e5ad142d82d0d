"""Schemas of what is read. Fixed, never inferred: a missing key is null and changes no schema."""

from __future__ import annotations

ACTION = "struct<action:string,id:string,input_val:string,value:string,dom_info:struct<attrs:map<string,string>,visible_text:string>>"
OPERATION = f"struct<type:string,subtype:string,is_duration:boolean,if_scroll:boolean,global_start_time:double,global_end_time:double,global_scroll_end_time:double,duration_seconds:double,description:string,action_detail:{ACTION}>"
SEGMENT = f"struct<segment_index:int,segment_start_time:double,segment_end_time:double,video_name:string,operations:array<{OPERATION}>>"
RECORDING = f"html_file string, total_compare_steps int, pass_num int, pass_rate double, action_frames_timeline_filtered array<{SEGMENT}>"
REPORT = "summary struct<total_steps:int,success:int,no_action:int,failed:int>, global_verification struct<visual_score:int,functional_score:string,is_match:boolean>, homepage_similarity struct<visual_score:int>"
GENERATION = "id string, mllm_generate string"
FRAME = "take_id string, frame_no int, fps int, status string"
