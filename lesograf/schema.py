"""Types of the treebank: a sentence is one row with its tokens nested; exploded views serve joins."""

from __future__ import annotations

#: One line of a treebank file. ``id`` stays text (word 3, range 3-4, empty node 8.1); ``word`` is the
#: number of a word, NULL for ranges and empty nodes; ``kind`` is word, range, empty or bad.
LINE = "struct<id:string,form:string,lemma:string,upos:string,xpos:string,feats:string,head:string,deprel:string,deps:string,misc:string,kind:string,word:int,head_id:int>"
#: A parsed token with its span in the sentence's text.
TOKEN = "struct<id:int,text:string,lemma:string,pos:string,feats:string,head_id:int,rel:string,start_char:int,end_char:int>"
SPAN = "struct<id:int,start_char:int,end_char:int>"
ALIGNMENT = "struct<sys_id:int,gold_id:int,iou:double,type:string>"
GROUP = "struct<sys_indices:array<int>,gold_indices:array<int>,type:string>"
OPCODE = "struct<tag:string,i1:int,i2:int,j1:int,j2:int>"
ERROR = "dataset string, sent_id string, model string, error_type string, gold string, pred string, context string"
PROFILE = "score double, length int, depth int, non_proj boolean, syntax_complexity int, is_dialogue boolean, pronouns int, propn_ratio double, hyphen_density double, abbr_count int, punct_clusters int, max_token_len int"
COLUMNS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
