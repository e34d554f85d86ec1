"""What the engine needs of a model, and stand-ins for tests and offline use.

A model is shipped to the executors and opened there (``open``), once for each Python worker.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import regex

from .functions.text import REFUSAL


QUESTION_INSTRUCTION = (
    'You are given an excerpt of the book "{title}" by {author}. Write one question (when, what or where) that this excerpt alone answers, '
    "an answer of at most two sentences that stands on its own, and the sentence of the excerpt that proves it, quoted without gaps. Reply in this form:\n"
    'Question: <question>\n\nAnswer: <answer>\n\nSupporting Passage: "<quotation>"\n'
)


def question_messages(chunk: str, title: str | None, author: str | None) -> tuple[str, str]:
    """The instruction and the excerpt, as a question model is sent them."""
    return QUESTION_INSTRUCTION.format(title=title or "untitled", author=author or "an unknown author"), f"Excerpt: {chunk}"


@runtime_checkable
class BoundaryModel(Protocol):
    """Maps a prompt to a reply. ``REFUSAL`` means that the model won't answer."""

    def complete(self, prompt: str) -> str: ...


@runtime_checkable
class QuestionModel(Protocol):
    def ask(self, chunk: str, title: str, author: str) -> str: ...


@runtime_checkable
class Embedder(Protocol):
    """Token vectors (tokens x dimensions) and the mask of each text."""

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]: ...


def ready(model: BoundaryModel) -> Callable[[str], str | None]:
    if hasattr(model, "open"):
        model.open()
    return model.complete


class LexicalModel:
    """The built-in boundary model as one that is called: it reads the prompt's rows."""

    def complete(self, prompt: str) -> str:
        rows, at = [], -1
        body = prompt.partition("Document:\n")[2]
        for line in body.split("\n"):
            head = regex.match(r"ID (\d+): ", line)
            if head and (at < 0 or int(head[1]) == at + 1):
                at = int(head[1])
                rows.append((at, line[head.end() :]))
            elif rows:
                rows[-1] = (rows[-1][0], f"{rows[-1][1]}\n{line}")
        jumps = [(abs(len(b) - len(a)), -i) for (_, a), (i, b) in zip(rows, rows[1:], strict=False)]
        return f"Answer: ID {-max(jumps)[1]}" if jumps else "No paragraph differs."


class QuotingModel:
    """The built-in question model: it asks for the place of a chunk's first line, which it quotes (less its quotation marks)."""

    def ask(self, chunk: str, title: str, author: str) -> str:
        line = chunk.partition("\n")[0].replace('"', "")
        start = line.partition(" ")[0]
        return f'Question: Where does {title} by {author} speak of {start}?\n\nAnswer: Where a line begins with {start}.\n\nSupporting Passage: "{line}"'


@dataclass
class ScriptedModel:
    """Gives its replies in turn (the last one from then on); a reply that is an exception is raised."""

    replies: list
    prompts: list[str] = field(default_factory=list)

    def complete(self, prompt: str) -> str:
        reply = self.replies[min(len(self.prompts), len(self.replies) - 1)]
        self.prompts.append(prompt)
        if isinstance(reply, Exception):
            raise reply
        return reply

    def ask(self, chunk: str, title: str, author: str) -> str:
        return self.complete(chunk)


@dataclass
class Patient:
    """Tries a model again with growing waits; what it never answers is null (status model_error).

    A refusal, known by ``refused``, isn't tried again.
    """

    model: BoundaryModel | QuestionModel
    tries: int = 5
    first_wait: float = 1.0
    longest_wait: float = 60.0
    #: fixed value: what the clients raise where an answer was blocked
    refused: Callable[[Exception], bool] = lambda e: str(e) == "list index out of range"
    sleep: Callable[[float], None] = time.sleep

    def open(self) -> None:
        if hasattr(self.model, "open"):
            self.model.open()

    def complete(self, prompt: str) -> str | None:
        return self._try(lambda: self.model.complete(prompt))

    def ask(self, chunk: str, title: str, author: str) -> str | None:
        return self._try(lambda: self.model.ask(chunk, title, author))

    def _try(self, call: Callable[[], str]) -> str | None:
        for k in range(self.tries):
            try:
                return call()
            except Exception as e:  # noqa: BLE001  a client may raise anything
                if self.refused(e):
                    return REFUSAL
                if k + 1 < self.tries:
                    self.sleep(min(self.longest_wait, self.first_wait * 2**k) * (0.5 + random.random() / 2))
        return None


@dataclass
class ChatModel:
    """A chat service with an OpenAI-like client; the client's package is imported on the executor."""

    name: str = "gpt-3.5-turbo-0125"
    temperature: float = 0.1
    system: str | None = None
    options: dict = field(default_factory=dict)

    def open(self) -> None:
        from openai import OpenAI

        self.client = OpenAI(**self.options)

    def complete(self, prompt: str) -> str:
        return self._send(self.system, prompt)

    def ask(self, chunk: str, title: str, author: str) -> str:
        return self._send(*question_messages(chunk, title, author))

    def _send(self, system: str | None, user: str) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": user}]
        return self.client.chat.completions.create(model=self.name, temperature=self.temperature, messages=messages).choices[0].message.content


@dataclass
class GenerativeModel:
    """A Gemini-like service with its safety thresholds off; the package is imported on the executor."""

    name: str = "gemini-pro"
    temperature: float = 0.1

    def open(self) -> None:
        from vertexai.generative_models import GenerativeModel as Client
        from vertexai.generative_models import HarmBlockThreshold, HarmCategory

        self.client = Client(self.name)
        # fixed values: the service's four categories, whose thresholds are turned off
        kinds = (HarmCategory.HARM_CATEGORY_DANGEROUS_CONTENT, HarmCategory.HARM_CATEGORY_HATE_SPEECH, HarmCategory.HARM_CATEGORY_HARASSMENT, HarmCategory.HARM_CATEGORY_SEXUALLY_EXPLICIT)
        self.safety = dict.fromkeys(kinds, HarmBlockThreshold.BLOCK_NONE)

    def ask(self, chunk: str, title: str, author: str) -> str:
        return self.complete("\n".join(question_messages(chunk, title, author)))

    def complete(self, prompt: str) -> str:
        return self.client.generate_content(contents=prompt, generation_config={"temperature": self.temperature}, safety_settings=self.safety).candidates[0].content.parts[0].text


@dataclass
class PretrainedEmbedder:
    """A pretrained encoder by name, opened once a Python worker; texts are cut where the encoder's input ends."""

    name: str = "facebook/contriever"

    def open(self) -> None:
        import torch
        from transformers import AutoModel, AutoTokenizer

        self.torch, self.split, self.net = torch, AutoTokenizer.from_pretrained(self.name), AutoModel.from_pretrained(self.name).eval()

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        given = self.split(texts, padding=True, truncation=True, return_tensors="pt")
        with self.torch.no_grad():
            hidden = self.net(**given).last_hidden_state
        return list(zip(hidden.numpy(), given["attention_mask"].numpy(), strict=True))


@dataclass
class LetterEmbedder:
    """A deterministic offline embedder: a word's vector counts its letters a to z; words of up to ``short`` letters are masked."""

    short: int = 3
    most_tokens: int | None = None

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for text in texts:
            x = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            word = np.cumsum(x == 32)  # of each byte; a space counts for none
            words = int(word[-1]) + 1 if len(x) else 1
            letter = (x >= 97) & (x <= 122)
            counts = np.bincount(word[letter] * 26 + (x[letter] - 97), minlength=26 * words).reshape(words, 26)
            sizes = np.bincount(word[(x != 32) & (x & 0xC0 != 0x80)], minlength=words)  # characters, not bytes
            out.append((counts[: self.most_tokens].astype(float), (sizes[: self.most_tokens] > self.short).astype(int)))
        return out


#: Boundary models by name, for the command line.
MODELS: dict[str, Callable[[], BoundaryModel]] = {"lexical": LexicalModel, "chatgpt": lambda: Patient(ChatModel()), "gemini": lambda: Patient(GenerativeModel())}
#: Question models by name.
QUESTION_MODELS: dict[str, Callable[[], QuestionModel]] = {
    "quoting": QuotingModel,
    "chatgpt": lambda: Patient(ChatModel(temperature=0.3)),
    "gemini": lambda: Patient(GenerativeModel(temperature=0.3)),
}
