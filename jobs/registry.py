"""The jobs as queries, and the SQL that states their output."""

from __future__ import annotations

from jobs import answer_questions, ingest_conversations

QUERIES = {"job1_ingest_conversations": ingest_conversations.job1_ingest_conversations, "job2_answer_questions": answer_questions.job2_answer_questions}
ORACLES = {"job1_ingest_conversations": ingest_conversations.SQL, "job2_answer_questions": answer_questions.SQL}
