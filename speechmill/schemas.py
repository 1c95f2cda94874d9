"""Declared schemas of the input documents and tables."""

from __future__ import annotations

# Field names and types of the exchange formats, as DDL.
CAPTURE = ("struct<device_manufacturer:string,device_model:string,os_version:string,app_version:string,input_route:string,"
           "source_sample_rate_hz:int,source_channels:int,session_id:string>")
_AUDIO = "recorded_at:string,duration_ms:bigint,sample_rate_hz:int,channels:int,encoding:string"
_CLIP = f"struct<id:string,file:string,label:string,prompt:string,spoken_phrase:string,{_AUDIO},conditions:array<string>,session_id:string,notes:string>"
_TAKE = f"struct<id:string,file:string,script:string,kind:string,{_AUDIO},capture:{CAPTURE},session_id:string,notes:string>"
_PLAIN_TAKE = f"struct<id:string,file:string,{_AUDIO},capture:{CAPTURE},session_id:string,notes:string>"

MANIFEST = (
    "schema_version int, exported_at string, app struct<package:string,version_name:string,version_code:bigint>, "
    "device struct<manufacturer:string,model:string,android_sdk:int>, "
    "wake_word struct<id:string,slug:string,phrase:string,target_phrases:array<string>,negative_phrases:array<string>>, "
    "prompt_batch struct<id:string,created_at:string,strategy:string>, "
    f"clips array<{_CLIP}>, bulk_recordings array<{_TAKE}>, background_recordings array<{_PLAIN_TAKE}>, test_recordings array<{_TAKE}>"
)

CORRECTIONS = (
    "schema_version int, wake_word struct<slug:string,phrase:string>, model struct<name:string,version:string,threshold:double>, "
    "corrections array<struct<id:string,file:string,label:string,score:double,spoken_phrase:string,source:string,notes:string,mistake:string>>"
)

TRANSCRIPT = "text string, segments array<struct<start:double,end:double,words:array<struct<word:string,start:double,end:double,probability:double>>>>"

RECORDINGS = (
    "id string, project_slug string, script string, recorded_at string, source_wav string, bundle string, duration_ms bigint, "
    "imported_at_ms bigint, capture_device_manufacturer string, capture_device_model string, capture_os_version string, "
    "capture_app_version string, capture_input_route string, capture_source_sample_rate_hz bigint, capture_source_channels bigint, "
    "capture_session_id string, source_sha256 string, kind string"
)

SLICES = (
    "id string, recording_id string, transcript_id bigint, project_slug string, label string, category string, spoken_phrase string, "
    "source_start_ms bigint, source_end_ms bigint, duration_ms bigint, avg_probability double, word_count bigint, wav_path string, "
    "file_name string, status string, created_at_ms bigint"
)
