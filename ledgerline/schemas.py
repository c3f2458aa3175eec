"""Record and panel schemas, and the constants of the analyses."""

ANCHOR, PLACEBO_ANCHOR = "2022-11", "2020-06"
MIN_PRE, POST_WINDOW, ES_LO, ES_HI, RESID_CLIP, PLACEBO_WINDOW = 12, 24, -24, 30, 5.0, 18
AI_GROUP, DEV_MIN_PRE, DEV_MIN_POST, DEV_POST_WINDOW, BIG_JUMP = 0.7, 4, 3, 24, 0.5
TIER_LOW, TIER_MID = 200, 2000
REACTIVATION_GAP = 6
CP_MIN, CP_MARGIN, CP_EFFECT, CP_TRIM, CP_PERMS, CP_P = 8, 3, 1.0, 6, 99, 0.05
GATE = {"pre": 18, "post": 9, "ratio": 0.70, "gap": 3, "devs": 3, "commits": 200}
MENTION_TERMS = ("claude", "copilot", "chatgpt", "gpt", "cursor", "cody", "tabnine", "codeium", "windsurf", "aider", "ai_generic")
Z95 = 1.959963984540054

RECORD = """provider string, repo_id string, name string, part int, clone_url string, default_branch string,
    gathered_at string, baseline_since string, shallow boolean, status string, schema int,
    meta struct<primary_language:string,stars:bigint,forks:bigint,created_at:string,pushed_at:string,size_kb:bigint,archived:boolean,visibility:string,description:string>,
    signatures struct<repo:map<string,string>,authors:map<string,map<string,string>>>,
    style map<string,map<string,map<string,double>>>, mentions map<string,map<string,bigint>>,
    months array<struct<ym:string,lang:string,ins:bigint,del:bigint,files:bigint,commits:bigint>>,
    activity array<struct<ym:string,commits:bigint,authors:bigint,active_days:bigint>>,
    authors array<struct<dev:string,ym:string,ins:bigint,del:bigint,commits:bigint,langs:array<string>,size_mean:double,size_std:double,size_max:bigint,weekend_share:double,evening_share:double>>,
    _corrupt string"""
