"""A few small source files, for queries and tests on code."""

FILES = {
    "app/reader.py": '''"""Reads records from JSON files."""
import json
import os
from app import store


class Reader:
    """Reads one file at a time."""

    def __init__(self, path: str, strict: bool = False):
        self.path = path
        self.store = Store()

    def load(self) -> list:
        # an empty file has no records
        with open(self.path) as f:
            return json.load(f)

    async def load_all(self, *paths, limit: int | None = None, **options):
        for p in paths:
            if p:
                await self.fetch(p)
        return self.store.put(self.load())

    async def fetch(self, p):
        return read_json(p)


class Store:
    def put(self, rows):
        return clean(rows)


def read_json(path):
    name = input("file? ")
    assert isinstance(name, str)
    root = os.environ["ROOT"]
    safe = escape(name)
    return Reader(path).load()


def clean(rows: list | None = None) -> list:
    return [r for r in rows or [] if check(r)]


def check(row):
    while row is None:
        row = clean(row)
    return bool(row)
''',
    "app/server.py": '''from app.reader import read_json


def handle_request(request):
    """Answers a request."""
    body = request.body
    body.validate()
    user = request.user
    return read_json(body)


def main():
    handle_request(None)
''',
    "web/client.ts": '''import { get } from "./http";

export interface Options { retries: number; }

/** Talks to the server. */
export class Client extends Base implements Options {
  constructor(private url: string) { super(); }

  async send(path: string, retries?: number): Promise<string> {
    for (const k of [1, 2]) {
      if (retries) { await get(this.url + path); }
    }
    return format(path);
  }
}

export const format = (text: string): string => text.trim();

function unused(a, b = 2) { return format(a); }
''',
    "svc/main.go": '''package main

import "fmt"

type Server struct { port int }

type Runner interface { Run() error }

func (s *Server) Run() error {
	defer fmt.Println("done")
	return start(s.port)
}

func start(port int) error { go listen(port); return nil }

func listen(port int) {}
''',
    "core/lib.rs": '''use std::fmt;

pub struct Point { x: i32 }

pub trait Shape { fn area(&self) -> i32; }

impl Shape for Point {
    fn area(&self) -> i32 { square(self.x) }
}

pub fn square(x: i32) -> i32 { if x > 0 { return mul(x, x); } 0 }

fn mul(a: i32, b: i32) -> i32 { a * b }
''',
    "src/Main.java": '''package demo;

public class Main extends Base implements Runnable {
    private int count;

    @Override
    public void run() { for (int i = 0; i < 3; i++) { step(i); } }

    static int step(int i) { return i + 1; }
}
''',
    "web/index.html": "<html><head><title>Start page</title></head><body></body></html>\n",
    "broken.py": "def oops(:\n",
}
