"""Invented run logs on disk."""

import json
import pathlib


def log(
    model="openai/gpt-4o", task="gpqa", status="success", accuracy=0.5, samples=(), usage=None, args=None, config=None,
    scores=None, run_id="r", total=2, completed=2, finished="2024-11-05T11:15:41-05:00",
):
    usage = usage or {model: {"input_tokens": 1000, "output_tokens": 100, "total_tokens": 1100}}
    if scores is None:
        scores = [
            {"name": "other", "metrics": {"accuracy": {"value": 0.1}, "stderr": {"value": 0.2}}},
            {"name": "choice", "metrics": {"accuracy": {"value": accuracy}, "stderr": {"value": 0.05}}},
            {"name": "choice", "metrics": {"accuracy": {"value": 0.9}, "stderr": {"value": 0.9}}},
        ]
    return {
        "version": 2,
        "status": status,
        "eval": {
            "task": task, "task_args": args or {"subset": "gpqa_main", "n_shot": 5}, "model": model, "run_id": run_id,
            "created": "2024-11-05T11:14:52-05:00", "dataset": {"samples": total, "name": "x"},
        },
        "plan": {"config": config or {}},
        "results": {"total_samples": total, "completed_samples": completed, "scores": scores},
        "stats": {"completed_at": finished, "model_usage": usage},
        "samples": list(samples),
    }


def sample(content, target="B", answer="B", ident=1):
    return {
        "id": ident, "input": "q", "target": target,
        "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": content}],
        "scores": {"choice": {"answer": answer, "explanation": "e"}},
        "output": {"choices": [{"message": {"content": content if isinstance(content, str) else json.dumps(content)}}]},
    }


COT_SAMPLES = [
    sample("so\nANSWER: B"),
    sample([{"type": "image", "image": "x"}, {"type": "text", "text": "ANSWER: C"}], ident=2),
    sample([{"type": "image", "image": "x"}], ident=3),
    sample("no idea", answer="none", ident=4),
    sample("ANSWER: C, A", target=["A", "C"], answer="", ident=5),
]


def name(i=0, second=52):
    return f"2024-11-05T11-14-{second:02d}-05-00_gpqa_{i:04d}.json"


def write(root, schema, benchmark, model, logs):
    folder = pathlib.Path(root) / schema / benchmark / model
    folder.mkdir(parents=True, exist_ok=True)
    for i, document in enumerate(logs):
        (folder / name(i)).write_text(json.dumps(document, indent=1))
    return folder


def tree(root):
    """Three directories: zero-shot with a failed log and two spellings, chain-of-thought, and an empty run."""
    write(root, "zero_shot", "gpqa", "gpt-4o", [
        log(run_id="a", accuracy=0.5), log(run_id="b", accuracy=0.75), log(run_id="c", status="error"),
        log(run_id="d", accuracy=0.7, task="benchmarks/gpqa", args={"subset": "old"}),
    ])
    write(root, "zero_shot_cot", "gpqa", "gpt-4o", [
        log(run_id="e", samples=COT_SAMPLES, total=5, completed=5, config={"n_shot": 0, "temperature": 1}),
        log(run_id="f", samples=[], total=0, completed=0),
    ])
    write(root, "zero_shot", "vct", "o3", [
        log(model="openai/o3", run_id="g", scores=[], completed=0, usage={
            "openai/o3": {"input_tokens": 1_000_000, "output_tokens": 1_000_000, "total_tokens": 2_000_000},
            "unknown/model": {"input_tokens": 5, "output_tokens": 5, "total_tokens": 10},
        }),
    ])
    return str(root)
